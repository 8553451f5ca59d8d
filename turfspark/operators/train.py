"""Binary models, stacking and ranking over year folds, on Spark ML.

Folds are few; a loop over them submits ordinary distributed fits. Data never
leaves the executors: what comes back is a model, a weight vector or a metric.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any, NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, ImputerModel, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfspark import constants as C
from turfspark.functions import market as M
from turfspark.functions import scalars as S
from turfspark.operators import filters, folds, joins, metrics, ranking
from turfspark.plans import registry
from turfspark.session import materialize, stored

FEATURES = "_features"
HELD = "_held"
GBT_ROUNDS = 20
HELD_SHARE = 0.1  # of the training races, by hash of the race
TOGETHER = 4  # folds that are fitted at the same time ...
TOGETHER_ROWS = 16_000_000  # ... while their tables together have so many rows; more fill the cores and the caches alone


def _learner(name: str, label: str, params: dict[str, Any], *, stop_early: bool = False):
    common = {"featuresCol": FEATURES, "labelCol": label}
    if name == "gbt":
        held = {"validationIndicatorCol": HELD, "validationTol": params.get("least_gain", 0.0)} if stop_early else {}
        return GBTClassifier(
            **common, **held, seed=42, maxIter=params.get("rounds", GBT_ROUNDS), maxDepth=params.get("depth", 4),
            stepSize=params.get("rate", 0.1), subsamplingRate=params.get("subsample", 1.0),
        )
    if name == "forest":
        return RandomForestClassifier(
            **common, seed=42, numTrees=params.get("trees", 40), maxDepth=params.get("depth", 6)
        )
    if name == "logistic":
        return LogisticRegression(
            **common, regParam=params.get("penalty", 1e-3), maxIter=params.get("rounds", 50)
        )
    raise ValueError(f"unknown learner {name!r}")


class Prepared(NamedTuple):
    """Medians and moments of the training rows of a fold: the same for every learner, label and parameter set."""

    imputer: ImputerModel
    scaler: StandardScalerModel | None


def _assembler(features: Sequence[str], output: str) -> VectorAssembler:
    return VectorAssembler(inputCols=[*[f"_f_{c}" for c in features], *[f"_m_{c}" for c in features]], outputCol=output)


def prepare(train: DataFrame, name: str, features: Sequence[str], known: Prepared | None = None) -> Prepared:
    """What a learner's inputs need of the training rows; `known` is taken over as far as it goes.

    A column without any value in the training rows is filled with 0.
    """
    if known is not None and (known.scaler is not None or name != "logistic"):
        return known
    ready = numeric_inputs(train, features)
    if known is None:
        counts = ready.agg(*[F.count(f"_n_{c}").alias(c) for c in features]).first()
        empty = [f"_n_{c}" for c in features if not counts[c]]
        # relative accuracy of the medians; exact ones need no place in a model
        imputer = Imputer(inputCols=[f"_n_{c}" for c in features], outputCols=[f"_f_{c}" for c in features], strategy="median")
        known = Prepared(imputer.fit(ready.fillna(0.0, empty) if empty else ready), None)
    if name != "logistic":
        return known
    raw = _assembler(features, "_raw_features").transform(known.imputer.transform(ready))
    return known._replace(scaler=StandardScaler(inputCol="_raw_features", outputCol=FEATURES, withMean=True).fit(raw))


def pipeline(
    name: str, features: Sequence[str], label: str, params: dict[str, Any] | None, prepared: Prepared, *, stop_early: bool = False
) -> Pipeline:
    """Median imputation with missing flags, assembly, (scaling) and the learner."""
    raw = FEATURES if name != "logistic" else "_raw_features"
    stages = [prepared.imputer, _assembler(features, raw)]
    if name == "logistic":
        stages.append(prepared.scaler)
    return Pipeline(stages=[*stages, _learner(name, label, params or {}, stop_early=stop_early)])


def numeric_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    columns = {f"_n_{c}": S.number(F.col(c)) for c in features}
    columns |= {f"_m_{c}": F.when(S.number(F.col(c)).isNull(), 1.0).otherwise(0.0) for c in features}
    return df.withColumns(columns)


def held_races(share: float = HELD_SHARE, seed: int = 42) -> Column:
    """Whether a race is held back to stop boosting; all rows of a race go together."""
    return F.pmod(F.xxhash64(F.lit(seed), "race_id"), F.lit(10_000)) < int(share * 10_000)


def best_round(model: PipelineModel) -> int | None:
    """Rounds (trees) that the fitted learner uses; None for one without rounds."""
    last = model.stages[-1]
    return last.getNumTrees if isinstance(last, GBTClassificationModel | RandomForestClassificationModel) else None


def fit_binary(
    train: DataFrame, name: str, features: Sequence[str], label: str, params: dict[str, Any] | None = None,
    *, stop_early: bool = False, prepared: Prepared | None = None,
) -> PipelineModel:
    """Fit one learner; `prepared` (of `prepare`) saves the passes for medians and moments.

    With `stop_early`, boosting ends in the first round that doesn't lower the loss of the held-back races, and
    the model keeps the rounds up to the best one (`best_round`). Without a held-back or without a remaining race
    it runs all its rounds.
    """
    ready = numeric_inputs(train, features)
    if stop_early and name == "gbt":
        ready = ready.withColumn(HELD, held_races((params or {}).get("held", HELD_SHARE)))
        sides = ready.agg(F.count(F.when(F.col(HELD), 1)).alias("held"), F.count(F.lit(1)).alias("rows")).first()
        stop_early = 0 < sides["held"] < sides["rows"]
    stages = pipeline(name, features, label, params, prepare(train, name, features, prepared), stop_early=stop_early and name == "gbt")
    return stages.fit(ready)


def predict_binary(model: PipelineModel, df: DataFrame, features: Sequence[str], output: str) -> DataFrame:
    scored = model.transform(numeric_inputs(df, features))
    return scored.withColumn(output, vector_to_array(F.col("probability"))[1]).select(*df.columns, output)


def together(df: DataFrame, step: Callable[[Any], Any], items: Sequence[Any]) -> list[Any]:
    """`step` of every item, in order; of several at the same time while `df` is small enough for that.

    A fit of few rows is many short jobs, which leave most cores idle; fits don't depend on each other.
    """
    at_once = min(TOGETHER, len(items))
    if at_once > 1:
        at_once = min(at_once, TOGETHER_ROWS // max(1, df.count()))
    if at_once < 2:
        return [step(item) for item in items]
    with ThreadPool(at_once) as pool:
        # each call binds the session's properties to its own thread
        return pool.map(lambda item: inheritable_thread_target(df.sparkSession)(step)(item), items, chunksize=1)


def fold_predictions(
    df: DataFrame,
    fold_frame: DataFrame,
    name: str,
    features: Sequence[str],
    label: str,
    output: str,
    *,
    params: dict[str, Any] | None = None,
    keep: Sequence[str] = (),
    train_rows: bool = False,
    prepared: dict[int, Prepared] | None = None,
) -> DataFrame:
    """Predictions of one learner in every fold, lazily: (keys, label, keep, output, fold_id, valid_year, role, best_round).

    `prepared` keeps what the folds' training rows gave for further learners on the same rows, folds and features.

    Each fold's model is fitted on its training years alone. `train_rows` adds its predictions of those years under
    role `train`, for what is fitted on predictions (temperatures).
    """
    keys = ["race_id", "horse_no", "field_size", label, *[c for c in keep if c != label]]
    parts = []
    prepared = {} if prepared is None else prepared
    years = folds.collect_folds(fold_frame)

    def fit(fold: tuple[int, list[int], int]) -> PipelineModel:
        fold_id, train_years, _ = fold
        train = df.filter(F.col("year").isin(train_years))
        prepared[fold_id] = prepare(train, name, features, prepared.get(fold_id))
        return fit_binary(train, name, features, label, params, stop_early=True, prepared=prepared[fold_id])

    for (fold_id, train_years, valid_year), model in zip(years, together(df, fit, years), strict=True):
        train = df.filter(F.col("year").isin(train_years))
        sides = [("valid", df.filter(F.col("year") == valid_year))] + ([("train", train)] if train_rows else [])
        for role, rows in sides:
            scored = predict_binary(model, rows, features, output)
            parts.append(
                scored.select(*keys, output).withColumns(
                    {
                        "fold_id": F.lit(fold_id),
                        "valid_year": F.lit(valid_year),
                        "role": F.lit(role),
                        "best_round": F.lit(best_round(model)).cast("int"),
                    }
                )
            )
    if not parts:
        raise ValueError("no fold: too few years before the holdout")
    return filters.concat_folds(parts)


def cross_validate(
    df: DataFrame,
    fold_frame: DataFrame,
    name: str,
    features: Sequence[str],
    label: str,
    output: str,
    *,
    holdout_year: int,
    params: dict[str, Any] | None = None,
    policy: str = "fixed_sliding",
    text: str | None = None,
    keep: Sequence[str] = (),
    prepared: dict[int, Prepared] | None = None,
) -> DataFrame:
    """Out-of-fold predictions of one learner: every row is scored by a model of earlier years.

    `best_round` is the number of rounds that the fold's model uses; `prepared` as in `fold_predictions`.
    """
    oof = fold_predictions(df, fold_frame, name, features, label, output, params=params, keep=keep, prepared=prepared).drop("role")
    return folds.attach_policy(oof, holdout_year, policy=policy, text=text)


def fold_metrics(oof: DataFrame, label: str, output: str) -> DataFrame:
    return metrics.binary_metrics(oof, label, output, by=["fold_id"])


def fold_sizes(df: DataFrame, fold_frame: DataFrame) -> DataFrame:
    """Rows and races of the training and the validation years of each fold."""
    members = folds.fold_members(df, fold_frame).groupBy("fold_id", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("race_id").alias("races")
    )
    side = lambda role, what: F.max(F.when(F.col("role") == role, F.col(what)))
    sizes = members.groupBy("fold_id").agg(
        *[F.coalesce(side(r, w), F.lit(0)).alias(f"{r}_{w}") for r in ("train", "valid") for w in ("rows", "races")]
    )
    return fold_frame.select("fold_id", "valid_year", "train_years").join(sizes, "fold_id")


def fold_report(df: DataFrame, fold_frame: DataFrame, oof: DataFrame, label: str, output: str) -> DataFrame:
    """One row per fold: years, sizes, the rounds used and the metrics of its validation year."""
    rounds = oof.groupBy("fold_id").agg(F.max("best_round").alias("best_round"))
    return fold_sizes(df, fold_frame).join(rounds, "fold_id").join(fold_metrics(oof, label, output), "fold_id")


def final_rounds(rounds: DataFrame, limit: int = GBT_ROUNDS, *, nearest: bool = False) -> int:
    """Rounds for the final fits: the exact median of the folds' best rounds, between 1 and the limit.

    Cut to a whole number, or, with `nearest`, rounded (halves to even). The limit if no fold has rounds.
    """
    middle = rounds.agg(F.median("best_round").alias("m"))  # one row per fold
    whole = F.bround("m", 0) if nearest else F.floor("m")
    found = middle.select(whole.cast("int").alias("m")).first()["m"]
    return limit if found is None else max(1, min(found, limit))


def win_temperatures(predictions: DataFrame, output: str, *, y: str = "y_win") -> dict[int, float]:
    """Temperature per fold, fitted on the predictions of its training years (role `train`)."""
    scored = predictions.filter("role = 'train'").withColumn("_score", M.logit(F.col(output)))
    return ranking.fit_betas(scored, "_score", "fold_id", y=y)


def win_evaluation(predictions: DataFrame, output: str, *, y: str = "y_win") -> tuple[DataFrame, DataFrame]:
    """Validation rows with win scores at the fold's temperature, and one row of pseudo-R² per fold.

    The temperature of a fold comes from its training years only.
    """
    betas = win_temperatures(predictions, output, y=y)
    late = ranking.add_win_scores_by(predictions.filter("role = 'valid'"), output, betas, "fold_id")
    fitted = ranking.win_r2_by(late, f"c_{output}_betahat", "fold_id", y=y)
    plain = ranking.win_r2_by(late, f"c_{output}_beta1", "fold_id", y=y).select("fold_id", F.col("r2").alias("r2_beta1"))
    report = fitted.join(plain, "fold_id").withColumn("beta_hat", ranking.by_key("fold_id", betas))
    return late, report


def final_fits(
    df: DataFrame, years: DataFrame, holdout_year: int, name: str, features: Sequence[str], label: str,
    params: dict[str, Any] | None = None, *, rounds: int | None = None, count: int = C.TRAIN_WINDOW_YEARS,
) -> dict[str, PipelineModel]:
    """Models for use: on the most recent years and on all years before the holdout.

    `rounds` (from `final_rounds`) fixes the number of boosting rounds; no race is held back then.
    """
    if rounds is not None:
        params = {**(params or {}), "rounds": rounds, "trees": rounds} if name != "logistic" else params
    recent = folds.recent_years(years, count, holdout_year=holdout_year)
    before = df.filter(F.col("year") < holdout_year)
    return {
        "recent": fit_binary(df.join(recent, "year", "left_semi"), name, features, label, params),
        "all_years": fit_binary(before, name, features, label, params),
    }


def holdout_predictions(
    model: PipelineModel, df: DataFrame, holdout_year: int, features: Sequence[str], output: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Predictions of the holdout years, with the year and the policy they were made under."""
    late = filters.holdout(df, holdout_year)
    scored = predict_binary(model, late, features, output)
    columns = [c for c in ("race_id", "horse_id", "horse_no", "race_date", "field_size", *keep) if c in df.columns]
    return folds.attach_policy(scored.select(*columns, output, F.col("year").alias("valid_year")), holdout_year)


def ensemble_predictions(
    df: DataFrame, fold_frame: DataFrame, features: Sequence[str], labels: Mapping[str, str], *, holdout_year: int,
    learners: Sequence[str] = registry.LEARNERS, params: Mapping[str, dict[str, Any]] | None = None,
) -> dict[str, DataFrame]:
    """Out-of-fold predictions `p_<task>_<learner>` of every learner for every task; `labels` maps task to label.

    `df` should be stored: each fit reads it.
    """
    prepared: dict[int, Prepared] = {}
    return {
        f"p_{task}_{name}": cross_validate(
            df, fold_frame, name, features, label, f"p_{task}_{name}", holdout_year=holdout_year,
            params=(params or {}).get(name), prepared=prepared,
        )
        for task, label in labels.items()
        for name in learners
    }


def stacker_input(features: DataFrame, oofs: dict[str, DataFrame], holdout_year: int) -> DataFrame:
    """Features with the out-of-fold predictions of all learners, complete rows only."""
    joined = joins.add_predictions(features, oofs)
    return filters.eligible(joined, list(oofs), holdout_year)


def stack(
    features: DataFrame,
    oofs: dict[str, DataFrame],
    columns: Sequence[str],
    label: str,
    output: str,
    *,
    holdout_year: int,
    name: str = "gbt",
    params: dict[str, Any] | None = None,
) -> DataFrame:
    """Second-layer out-of-fold predictions over capped expanding year folds."""
    rows = stacker_input(features, oofs, holdout_year)
    fold_frame = folds.stacker_folds(folds.years_of(rows, "year"), holdout_year)
    return cross_validate(
        rows, fold_frame, name, columns, label, output, holdout_year=holdout_year, params=params,
        policy="capped_expanding", text=folds.capped_window_text(),
    )


class Stacked(NamedTuple):
    """A second layer: its rows, folds, columns and predictions."""

    rows: DataFrame
    folds: DataFrame
    columns: list[str]
    oof: DataFrame


def stack_task(
    features: DataFrame, oofs: Mapping[str, DataFrame], task: str, label: str, *, holdout_year: int, name: str = "gbt",
    params: dict[str, Any] | None = None, store=stored,
) -> Stacked:
    """The second layer of a task by its contract: the task's first-layer predictions, odds snapshots and context.

    Predictions with a repeated key are refused, so are a missing column of the contract and an empty result.
    Rows before the holdout with all of the task's predictions count; they are stored once for all folds.
    """
    own = {c: frame for c, frame in oofs.items() if c.startswith(f"p_{task}_")}
    rows = store(stacker_input(features, own, holdout_year))
    if rows.isEmpty():
        raise ValueError(f"stacker {task}: no row before {holdout_year} has all of {sorted(own)}")
    columns = registry.stacker_features(rows.columns, task=task, learners=[c.split("_", 2)[2] for c in own])
    fold_frame = folds.stacker_folds(folds.years_of(rows, "year"), holdout_year)
    oof = cross_validate(
        rows, fold_frame, name, columns, label, f"p_{task}_stack", holdout_year=holdout_year, params=params,
        policy="capped_expanding", text=folds.capped_window_text(),
    )
    return Stacked(rows, fold_frame, columns, oof)


# --- ranking layer -----------------------------------------------------------


class Ranked(NamedTuple):
    """Scored rows with top-3 probabilities, pairs, and metrics by fold and by fold and segment."""

    horses: DataFrame
    pairs: DataFrame
    metrics: DataFrame
    segments: DataFrame


def fit_ranking(train: DataFrame, features: Sequence[str], by: str, *, steps: int = 30) -> DataFrame:
    """The ranking layer of every group of `by` as a table (see `ranking.model_table`).

    `by` is a group or an array of the groups a row belongs to.
    """
    members = train.withColumn(by, F.explode(by)) if dict(train.dtypes)[by].startswith("array") else train
    stats = materialize(ranking.feature_stats_by(members, features, by))
    found: dict[Any, dict[str, Any]] = {}
    for row in stats.collect():  # a row per fold and feature
        found.setdefault(row[by], {})[row["feature"]] = row
    rows = {key: [own[n] for n in features] for key, own in found.items()}
    fits = ranking.fit_pl_by(train, features, by, moments=rows, steps=steps)
    return materialize(ranking.model_table(stats, fits, features, by))


def fit_ranking_folds(df: DataFrame, features: Sequence[str], fold_frame: DataFrame, *, steps: int = 30) -> DataFrame:
    """One ranking layer per fold, fitted on its training years; all folds share every pass over the data."""
    years: dict[int, list[int]] = {}
    for fold_id, train_years, _ in folds.collect_folds(fold_frame):
        for year in train_years:
            years.setdefault(year, []).append(fold_id)
    if not years:
        raise ValueError("no fold: too few years before the holdout")
    lists = ranking.by_key("year", {year: F.array(*[F.lit(f) for f in found]) for year, found in years.items()})
    train = df.filter(F.col("year").isin(list(years))).select("race_id", "horse_no", "finish_pos", *features, lists.alias("fold_id"))
    return fit_ranking(stored(train), features, "fold_id", steps=steps)


def rank_rows(scored: DataFrame, *, holdout_year: int, years: int, by: str = "fold_id") -> Ranked:
    """Probabilities, pairs and metrics of rows with `pl_score`, `fold_id`, `valid_year`, `finish_pos` and `is_3yo`."""
    finish = S.number(F.col("finish_pos"))
    labelled = scored.withColumn("y_top3", F.when(finish.isNotNull(), (finish <= 3).cast("int")))
    policy = lambda frame: folds.attach_policy(frame, holdout_year, years=years)
    pair = stored(ranking.pair_probabilities(labelled, "pl_score"))
    single = ranking.top3_from_pairs(labelled, "pl_score", pair)
    horses = stored(policy(labelled.join(single, ["race_id", "horse_no"], "left")))
    fold_of = horses.select("race_id", by, "valid_year").distinct()
    pairs = policy(ranking.with_members(pair, horses).join(fold_of, "race_id"))
    loss = ranking.pl_terms(ranking.finish_groups(horses), "pl_score").groupBy(by, "race_id").agg(F.sum("nll").alias("_l"))
    nll = loss.groupBy(by).agg(F.avg("_l").alias("pl_nll"), F.count(F.lit(1)).alias("nll_races"))
    sizes = horses.groupBy(by, "valid_year").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("race_id").alias("races"))
    known = metrics.binary_metrics(horses, "y_top3", "p_top3", by=[by])
    segments = metrics.segment_metrics(horses, "y_top3", "p_top3", metrics.age_segment(F.col("is_3yo")), by=[by])
    return Ranked(horses, pairs, sizes.join(nll, by, "left").join(known, by, "left"), segments)


def rank_cross_validate(
    df: DataFrame, features: Sequence[str], *, holdout_year: int, window: int = 3, steps: int = 30
) -> tuple[DataFrame, Ranked]:
    """The ranking layer over sliding year folds: its model table, and every fold's scored validation year."""
    fold_frame = materialize(folds.year_folds(folds.years_of(df, "year"), holdout_year, least=window))
    model = fit_ranking_folds(df, features, fold_frame, steps=steps)
    valid = folds.fold_members(df, fold_frame).filter("role = 'valid'").withColumn("valid_year", F.col("year")).drop("role")
    scored = stored(ranking.score_by(valid, model, "fold_id"))  # read by every branch of the pairs
    return model, rank_rows(scored, holdout_year=holdout_year, years=window)


def fit_ranking_recent(
    df: DataFrame, features: Sequence[str], *, holdout_year: int, window: int = C.TRAIN_WINDOW_YEARS, steps: int = 30
) -> DataFrame:
    """The ranking layer of the most recent years before the holdout, as a table of one group (fold 0)."""
    recent = folds.recent_years(folds.years_of(df, "year"), window, holdout_year=holdout_year)
    train = df.join(recent, "year", "left_semi").select("race_id", "horse_no", "finish_pos", *features, F.lit(0).alias("fold_id"))
    return fit_ranking(stored(train), features, "fold_id", steps=steps)


def rank_holdout_with(
    df: DataFrame, model: DataFrame, *, holdout_year: int, window: int = C.TRAIN_WINDOW_YEARS
) -> Ranked:
    """Holdout years scored with a stored model table of one group: horses, pairs, metrics and segments."""
    late = filters.holdout(df, holdout_year).withColumns({"fold_id": F.lit(0), "valid_year": F.col("year")})
    return rank_rows(stored(ranking.score_by(late, model, "fold_id")), holdout_year=holdout_year, years=window)


def rank_holdout(
    df: DataFrame, features: Sequence[str], *, holdout_year: int, steps: int = 30
) -> DataFrame:
    """Scores of the holdout years from weights fitted on the most recent years before them."""
    recent = folds.recent_years(folds.years_of(df, "year"), holdout_year=holdout_year)
    train = stored(df.join(recent, "year", "left_semi").select("race_id", "horse_no", "finish_pos", *features))
    stats = ranking.feature_stats(train, features)
    weights, _ = ranking.fit_pl(ranking.standardize(train, stats), features, steps=steps)
    late = ranking.standardize(filters.holdout(df, holdout_year), stats)
    return late.withColumn("pl_score", ranking.linear_score(features, weights))


# --- search ------------------------------------------------------------------


def trial_table(predictions: DataFrame, label: str, output: str, *, y_win: str | None = None) -> DataFrame:
    """Trials as rows from their predictions (trial, fold_id, race_id, label, output), all in one pass.

    `mean_logloss` is the mean over folds, `median_round` that of the best rounds; with `y_win` the mean, median and
    least pseudo-R² of the folds at temperature 1 are added. A trial with a fold that has no loss is FAIL.
    """
    by = ["trial", "fold_id"]
    known = predictions.filter(F.col(label).isNotNull() & F.col(output).isNotNull())
    p = M.clip(F.col(output), C.PROB_EPS, 1.0 - C.PROB_EPS)
    per_fold = known.groupBy(*by).agg(F.avg(M.log_loss(F.col(label), p)).alias("logloss"), F.max("best_round").alias("best_round"))
    if y_win is not None:
        # logits are bounded, so the winner's share of a race needs no shift and one aggregate gives it
        power = F.exp(S.number(M.logit(F.col(output))))
        won = F.when(F.col(y_win) == 1, power)
        races = predictions.withColumn("race_id", F.struct(*by, "race_id")).groupBy("race_id").agg(
            F.max(won).alias("_won"), F.sum(power).alias("_all"), F.count(F.when(F.col(y_win) == 1, 1)).alias("_n"),
            F.max(S.number(F.col("field_size"))).alias("field_size"),
        )
        # one row per race, with its winner if there is exactly one
        fit = ranking.race_fit(races.select("*", F.when(F.col("_n") == 1, 1).alias("_y"), (F.col("_won") / F.col("_all")).alias("_c")), "_c", y="_y")
        model, null = F.sum("nll_model"), F.sum("nll_null")
        r2 = fit.groupBy("race_id.trial", "race_id.fold_id").agg(F.when(null > 0, 1.0 - model / null).alias("r2"))
        per_fold = per_fold.join(r2, by, "left")
    else:
        per_fold = per_fold.withColumn("r2", F.lit(None).cast("double"))
    complete = F.count(F.when(F.col("logloss").isNull() | F.isnan("logloss"), 1)) == 0
    return per_fold.groupBy("trial").agg(
        F.when(complete, "COMPLETE").otherwise("FAIL").alias("state"),
        F.avg("logloss").alias("mean_logloss"),
        F.avg("r2").alias("r2_mean"),
        F.median("r2").alias("r2_median"),
        F.min("r2").alias("r2_min"),
        F.median("best_round").alias("median_round"),
        F.count(F.lit(1)).alias("folds"),
    )


def fit_grid(
    train: DataFrame, name: str, features: Sequence[str], label: str, grid: Sequence[dict[str, Any]], prepared: Prepared
) -> list[PipelineModel]:
    """The fits of all parameter sets on the same rows, as `fit_binary` with `stop_early` makes them.

    Logistic fits of one penalty take the same steps whatever their limit of rounds. So one that has converged
    before its limit is the fit of every limit from its rounds on; others are fitted anew.
    """
    converged: dict[str, tuple[int, PipelineModel]] = {}
    order = sorted(range(len(grid)), key=lambda i: grid[i].get("rounds", 0)) if name == "logistic" else range(len(grid))
    found: dict[int, PipelineModel] = {}
    for i in order:
        params = grid[i]
        same = str(sorted((k, v) for k, v in params.items() if k != "rounds"))
        known = converged.get(same)
        if known is not None and known[0] < params.get("rounds", 0):
            found[i] = known[1]
            continue
        found[i] = fit_binary(train, name, features, label, params, stop_early=True, prepared=prepared)
        last = found[i].stages[-1]
        if isinstance(last, LogisticRegressionModel) and last.summary.totalIterations < last.getMaxIter():
            converged[same] = last.summary.totalIterations, found[i]
    return [found[i] for i in range(len(grid))]


def predict_grid(models: Sequence[PipelineModel], df: DataFrame, features: Sequence[str], output: str) -> DataFrame:
    """Rows of `df` once per model, with `trial`, `best_round` and the model's probability; the inputs are made once a row."""
    scored = numeric_inputs(df, features)
    for stage in models[0].stages[:-1]:  # the same for all parameter sets
        scored = stage.transform(scored)
    trials = []
    for trial, model in enumerate(models):
        own = model.stages[-1].copy().setProbabilityCol(f"_p_{trial}").setRawPredictionCol("").setPredictionCol("")
        scored = own.transform(scored)
        trials.append(
            F.struct(
                F.lit(trial).alias("trial"), F.lit(best_round(model)).cast("int").alias("best_round"),
                vector_to_array(F.col(f"_p_{trial}"))[1].alias(output),
            )
        )
    return scored.select(*df.columns, F.inline(F.array(*trials)))


def search_trials(
    df: DataFrame,
    fold_frame: DataFrame,
    name: str,
    features: Sequence[str],
    label: str,
    grid: Sequence[dict[str, Any]],
    *,
    y_win: str | None = None,
    store=stored,
) -> DataFrame:
    """One row per parameter set, for `selection.best_trial`: metrics and, as text, the parameters.

    `df` should be stored. Predictions of all trials are stored once, each row read once for all of them, then
    measured in one pass.
    """
    keep = [c for c in (y_win,) if c is not None and c != label]
    years = folds.collect_folds(fold_frame)
    if not years:
        raise ValueError("no fold: too few years before the holdout")

    def fit(fold: tuple[int, list[int], int]) -> list[PipelineModel]:
        train = df.filter(F.col("year").isin(fold[1]))
        return fit_grid(train, name, features, label, grid, prepare(train, name, features))

    inputs = list(dict.fromkeys(["race_id", "field_size", label, *keep, *features]))
    parts = []
    for (fold_id, _, valid_year), models in zip(years, together(df, fit, years), strict=True):
        valid = df.filter(F.col("year") == valid_year).select(*inputs)
        scored = predict_grid(models, valid, features, "_p").withColumn("fold_id", F.lit(fold_id))
        parts.append(scored.select("trial", "fold_id", "race_id", "field_size", label, *keep, "best_round", "_p"))
    table = trial_table(store(filters.concat_folds(parts)), label, "_p", y_win=y_win)
    texts = {trial: str(sorted(params.items())) for trial, params in enumerate(grid)}
    return table.withColumn("params", ranking.by_key("trial", texts))
