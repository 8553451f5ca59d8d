"""The model layers end to end: early stopping, final fits, temperatures, stackers, ranking folds, holdout, search.

Fitted values have no SQL. What SQL can say of a fit stands beside it: keys, folds, years, sizes and the rules that
its values obey; temperatures, scores, metrics and the choice of trials are compared in full on values that the
tables hold. Predictions are stored once per session and folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark.catalog import ranking as _ranking  # noqa: F401  its SQL names are used here
from turfspark.catalog import training
from turfspark.catalog.base import Tables, cte, query
from turfspark.functions import market as M
from turfspark.operators import filters, folds, joins, metrics, ranking, selection, train
from turfspark.plans import registry
from turfspark.session import materialize, stored

HOLDOUT = training.HOLDOUT
_STORED: dict[tuple[str, str, str], object] = {}


def _once(t: Tables, name: str, make: Callable[[], object]):
    """What `make` gives, kept for the session and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


# years before 2001, and the folds over them: three years of training, or two to three for the second layer
cte("dated", "SELECT s.*, year(r.race_date) AS year, r.distance_m FROM scored s JOIN race r USING (race_id)", "scored", "race")
cte("year_list", "SELECT list(DISTINCT year ORDER BY year) AS years FROM dated WHERE year < 2001", "dated")
cte(
    "fold",
    """
    SELECT i - 3 AS fold_id, years[i] AS valid_year, years[i - 3:i - 1] AS train_years
    FROM (SELECT years, unnest(range(4, len(years) + 1)) AS i FROM year_list)
    """,
    "year_list",
)
cte(
    "stack_fold",
    """
    SELECT i - 2 AS fold_id, v[i] AS valid_year, v[greatest(1, i - 3):i - 1] AS train_years
    FROM (SELECT v, unnest(range(3, len(v) + 1)) AS i FROM (SELECT list(valid_year ORDER BY valid_year) AS v FROM fold))
    """,
    "fold",
)
cte("fold_train", "SELECT f.fold_id, f.valid_year, d.* FROM fold f JOIN dated d ON list_contains(f.train_years, d.year)", "fold", "dated")
cte("fold_valid", "SELECT f.fold_id, f.valid_year, d.* FROM fold f JOIN dated d ON f.valid_year = d.year", "fold", "dated")

_SLIDING = "'fixed_sliding' AS cv_window_policy, 3 AS train_window_years, 2001 AS holdout_year"
_SLIDING += ", 'train = previous 3 years only, valid = current year' AS window_definition"
_POLICY = ["cv_window_policy", "train_window_years", "holdout_year", "window_definition"]


def contract_rows(t: Tables) -> DataFrame:
    """Rows with labels, features, odds snapshots and context under the names of the feature contract."""

    def make() -> DataFrame:
        race = t.race.drop("post_minute", "start_time", "race_no")
        month = F.month("race_date") * (2 * 3.141592653589793 / 12)
        snapshots = {"t20": 1.2, "t15": 1.1, "t10": 1.0}
        rows = t.scored.join(race, "race_id").withColumns(
            {
                "year": F.year("race_date"),
                "y_place": F.col("y"),
                "is_3yo": (F.col("part") % 2).cast("int"),
                "race_month_sin": F.sin(month),
                "race_month_cos": F.cos(month),
                "prior_starts_2y": F.col("part") % 7,
                **{f"p_win_odds_{k}_norm": F.pow(F.col("p"), F.lit(v)) for k, v in snapshots.items()},
                **{f"place_mid_prob_{k}": F.sqrt(F.col("p")) / v for k, v in snapshots.items()},
                **{f"place_width_log_ratio_{k}": F.log1p("price") / (10 * v) for k, v in snapshots.items()},
            }
        )
        norm = lambda k: F.col(f"p_win_odds_t{k}_norm")
        moved = {f"d_logit_win_{a}_{b}": M.logit_delta(norm(a), norm(b)) for a, b in ((15, 20), (10, 15), (10, 20))}
        moved["d_place_mid_10_20"] = F.col("place_mid_prob_t10") - F.col("place_mid_prob_t20")
        moved["d_place_width_10_20"] = F.col("place_width_log_ratio_t10") - F.col("place_width_log_ratio_t20")
        share = rows.groupBy("race_id").agg(F.avg("is_3yo").alias("share_3yo_in_race"))
        return stored(rows.withColumns(moved).join(share, "race_id"))

    return _once(t, "contract", make)


def _folds(rows: DataFrame) -> DataFrame:
    return folds.year_folds(folds.years_of(rows, "year"), HOLDOUT)


# --- boosting with early stopping, final fits --------------------------------


def boosted(t: Tables) -> DataFrame:
    """Predictions of boosting with early stopping for `y_win`, training rows too."""

    def make() -> DataFrame:
        rows = contract_rows(t)
        return stored(
            train.fold_predictions(rows, _folds(rows), "gbt", training.FEATURES, "y_win", "p_gbt", train_rows=True)
        )

    return _once(t, "boosted", make)


@query(
    "early_stopping_folds",
    """
    SELECT fold_id, valid_year, train_years[1] AS first_train_year, train_years[-1] AS last_train_year,
           (SELECT count(*) FROM fold_train t WHERE t.fold_id = f.fold_id) AS train_rows,
           (SELECT count(DISTINCT race_id) FROM fold_train t WHERE t.fold_id = f.fold_id) AS train_races,
           (SELECT count(*) FROM fold_valid t WHERE t.fold_id = f.fold_id) AS valid_rows,
           (SELECT count(DISTINCT race_id) FROM fold_valid t WHERE t.fold_id = f.fold_id) AS valid_races,
           (SELECT count(*) FROM fold_valid t WHERE t.fold_id = f.fold_id) AS scored_rows,
           (SELECT round(avg(y_win), 6) FROM fold_valid t WHERE t.fold_id = f.fold_id) AS base_rate,
           true AS rounds_in_range
    FROM fold f
    """,
    ["fold_train", "fold_valid"],
)
def early_stopping_folds(t: Tables) -> DataFrame:
    rows, oof = contract_rows(t), boosted(t).filter("role = 'valid'")
    report = train.fold_report(rows, _folds(rows), oof, "y_win", "p_gbt")
    years = F.col("train_years")
    return report.select(
        "fold_id", "valid_year", F.array_min(years).alias("first_train_year"), F.array_max(years).alias("last_train_year"),
        "train_rows", "train_races", "valid_rows", "valid_races", F.col("n_rows").alias("scored_rows"),
        F.round("base_rate", 6).alias("base_rate"), F.col("best_round").between(1, train.GBT_ROUNDS).alias("rounds_in_range"),
    )


@query("early_stopping_report")
def early_stopping_report(t: Tables) -> DataFrame:
    rows, oof = contract_rows(t), boosted(t).filter("role = 'valid'")
    return train.fold_report(rows, _folds(rows), oof, "y_win", "p_gbt")


def _final_rounds(t: Tables) -> tuple[int, DataFrame]:
    rounds = boosted(t).groupBy("fold_id").agg(F.max("best_round").alias("best_round"))
    return train.final_rounds(rounds), rounds


@query(
    "final_fit_rounds",
    """
    SELECT 'all_years' AS model, min(year) AS first_year, max(year) AS last_year, count(*) AS train_rows,
           count(DISTINCT race_id) AS train_races, true AS uses_median_round FROM dated WHERE year < 2001
    UNION ALL
    SELECT 'recent', min(year), max(year), count(*), count(DISTINCT race_id), true FROM dated, year_list
    WHERE list_contains(years[-3:], year)
    """,
    ["dated", "year_list"],
)
def final_fit_rounds(t: Tables) -> DataFrame:
    """Both final models use exactly the median round of the folds."""
    rows = contract_rows(t)
    wanted, rounds = _final_rounds(t)
    middle = F.floor(F.expr("percentile(best_round, 0.5)")).cast("int")
    expected = rounds.agg(F.least(F.greatest(middle, F.lit(1)), F.lit(train.GBT_ROUNDS)).alias("expected")).first()["expected"]
    years = folds.years_of(rows, "year")
    models = train.final_fits(rows, years, HOLDOUT, "gbt", training.FEATURES, "y_win", rounds=wanted)
    before = rows.filter(F.col("year") < HOLDOUT)
    windows = {"all_years": before, "recent": rows.join(folds.recent_years(years, holdout_year=HOLDOUT), "year", "left_semi")}
    parts = [
        frame.agg(
            F.lit(name).alias("model"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
            F.count(F.lit(1)).alias("train_rows"), F.count_distinct("race_id").alias("train_races"),
        ).withColumn("used", F.lit(train.best_round(models[name])))
        for name, frame in windows.items()
    ]
    return filters.concat_folds(parts).withColumn("uses_median_round", F.col("used") == expected).drop("used")


@query(
    "final_model_holdout",
    f"SELECT race_id, horse_id, horse_no, y_win, year AS valid_year, {_SLIDING}, true AS in_range FROM dated WHERE year >= 2001",
    ["dated"],
)
def final_model_holdout(t: Tables) -> DataFrame:
    rows = contract_rows(t)
    models = train.final_fits(
        rows, folds.years_of(rows, "year"), HOLDOUT, "gbt", training.FEATURES, "y_win", rounds=_final_rounds(t)[0]
    )
    late = train.holdout_predictions(models["recent"], rows, HOLDOUT, training.FEATURES, "p_gbt", ["y_win"])
    return late.select(
        "race_id", "horse_id", "horse_no", "y_win", "valid_year", *_POLICY, F.col("p_gbt").between(0, 1).alias("in_range")
    )


# --- temperatures per fold ---------------------------------------------------

_LOGIT = "ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)))"


def given_predictions(t: Tables) -> DataFrame:
    """The probability of the tables as a prediction of every fold, in its training and validation years."""
    members = folds.fold_members(contract_rows(t), _folds(contract_rows(t)))
    valid = _folds(contract_rows(t)).select("fold_id", "valid_year")
    kept = members.select("fold_id", "role", "race_id", "horse_no", "field_size", "y_win", "y", "is_3yo", "finish_pos", "score", "p")
    return kept.join(valid, "fold_id")


@query(
    "temperature_by_fold",
    f"""
    WITH scores AS (SELECT fold_id, race_id, y_win, field_size, {_LOGIT} AS s FROM fold_train),
         gaps AS (SELECT *, s - max(s) OVER (PARTITION BY fold_id, race_id) AS gap FROM scores WHERE field_size > 1),
         losses AS (SELECT fold_id, idx, race_id, ln(sum(exp(beta * gap))) - max(CASE WHEN y_win = 1 THEN beta * gap END) AS loss
                    FROM gaps, (SELECT i AS idx, pow(10, -2 + 4.0 * i / 80) AS beta FROM range(81) g(i)) GROUP BY ALL),
         totals AS (SELECT fold_id, idx, sum(least(loss, -ln(1e-12))) AS nll, count(*) AS races FROM losses GROUP BY ALL)
    SELECT fold_id, idx, round(nll, 3) AS nll, races FROM totals
    """,
    ["fold_train"],
)
def temperature_by_fold(t: Tables) -> DataFrame:
    """Loss of every temperature of the grid in every fold's training years, in one pass."""
    rows = given_predictions(t).filter("role = 'train'").withColumn("_score", M.logit(F.col("p")))
    grids = dict.fromkeys([f for f, _, _ in folds.collect_folds(_folds(contract_rows(t)))], ranking.beta_grid())
    losses = ranking.beta_losses_by(rows, "_score", grids, "fold_id")
    return losses.select("fold_id", F.col("idx").cast("bigint").alias("idx"), F.round("nll", 3).alias("nll"), "races")


@query(
    "win_evaluation_folds",
    f"""
    WITH rows_ AS (SELECT fold_id, race_id, y_win, field_size, {_LOGIT} AS s FROM fold_valid),
         soft AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY race_id) AS c FROM rows_)
    SELECT fold_id, count(*) AS races, round(sum(ln(field_size)), 4) AS nll_null,
           round(1 - sum(-ln(c)) / sum(ln(field_size)), 6) AS r2_beta1, true AS fitted_on_train
    FROM soft WHERE y_win = 1 AND field_size > 1 GROUP BY fold_id
    """,
    ["fold_valid"],
)
def win_evaluation_folds(t: Tables) -> DataFrame:
    """Validation years at temperature 1, and whether the fitted one does no worse than 1 in the training years."""
    rows = stored(given_predictions(t))
    _, report = train.win_evaluation(rows, "p")
    betas = train.win_temperatures(rows, "p")
    scored = rows.filter("role = 'train'").withColumn("_score", M.logit(F.col("p")))
    both = ranking.beta_losses_by(scored, "_score", {k: [1.0, b] for k, b in betas.items()}, "fold_id")
    better = both.groupBy("fold_id").agg(
        (F.max(F.when(F.col("idx") == 1, F.col("nll"))) <= F.max(F.when(F.col("idx") == 0, F.col("nll")))).alias("fitted_on_train")
    )
    return report.join(better, "fold_id").select(
        "fold_id", "races", F.round("nll_null", 4).alias("nll_null"), F.round("r2_beta1", 6).alias("r2_beta1"), "fitted_on_train"
    )


@query("boosted_win_evaluation")
def boosted_win_evaluation(t: Tables) -> DataFrame:
    return train.win_evaluation(boosted(t), "p_gbt")[1]


# --- three learners, two tasks, and their second layers ----------------------


def learner_oofs(t: Tables) -> dict[str, DataFrame]:
    def make() -> dict[str, DataFrame]:
        rows = contract_rows(t)
        labels = {"win": "y_win", "place": "y_place"}
        found = train.ensemble_predictions(rows, _folds(rows), training.FEATURES, labels, holdout_year=HOLDOUT)
        return {column: stored(frame) for column, frame in found.items()}

    return _once(t, "learners", make)


@query(
    "learner_predictions",
    "SELECT race_id, horse_no, fold_id, valid_year, 6 AS predictions FROM fold_valid",
    ["fold_valid"],
)
def learner_predictions(t: Tables) -> DataFrame:
    oofs = learner_oofs(t)
    keys = next(iter(oofs.values())).select("race_id", "horse_no", "fold_id", "valid_year")
    wide = joins.add_predictions(keys, oofs)
    known = [F.when(F.col(c).between(0, 1), 1).otherwise(0) for c in oofs]
    return wide.select("race_id", "horse_no", "fold_id", "valid_year", sum(known[1:], known[0]).alias("predictions"))


def stacked(t: Tables, task: str) -> train.Stacked:
    def make() -> train.Stacked:
        found = train.stack_task(contract_rows(t), learner_oofs(t), task, f"y_{task}", holdout_year=HOLDOUT)
        return found._replace(oof=stored(found.oof))

    return _once(t, f"stack_{task}", make)


_STACKED = """
    SELECT d.race_id, d.horse_no, f.fold_id, f.valid_year, 'capped_expanding' AS cv_window_policy,
           'train = capped expanding years (min=2, max=3), valid = next year' AS window_definition, true AS in_range
    FROM stack_fold f JOIN fold_valid d ON d.valid_year = f.valid_year
"""


def _stacker_oof(t: Tables, task: str) -> DataFrame:
    return stacked(t, task).oof.select(
        "race_id", "horse_no", "fold_id", "valid_year", "cv_window_policy", "window_definition",
        F.col(f"p_{task}_stack").between(0, 1).alias("in_range"),
    )


@query("stacker_win_oof", _STACKED, ["stack_fold", "fold_valid"])
def stacker_win_oof(t: Tables) -> DataFrame:
    return _stacker_oof(t, "win")


@query("stacker_place_oof", _STACKED, ["stack_fold", "fold_valid"])
def stacker_place_oof(t: Tables) -> DataFrame:
    return _stacker_oof(t, "place")


@query("stacker_reports")
def stacker_reports(t: Tables) -> DataFrame:
    parts = []
    for task in ("win", "place"):
        found = stacked(t, task)
        report = train.fold_report(found.rows, found.folds, found.oof, f"y_{task}", f"p_{task}_stack")
        parts.append(report.withColumn("task", F.lit(task)))
    return filters.concat_folds(parts)


# --- ranking layer -----------------------------------------------------------


def ranked(t: Tables) -> tuple[DataFrame, DataFrame, train.Ranked]:
    """Inputs of the ranking layer, its model table, and the scored validation years."""

    def make():
        rows = stored(training._ranking_inputs(t))
        names = registry.ranking_features(rows.columns, profile="stack_default")
        return rows, *train.rank_cross_validate(rows, names, holdout_year=HOLDOUT)

    return _once(t, "ranked", make)


@query(
    "ranking_cv_horses",
    f"""
    SELECT race_id, horse_no, fold_id, valid_year, {_SLIDING}, least(field_size, 3) AS race_total FROM fold_valid
    """,
    ["fold_valid"],
)
def ranking_cv_horses(t: Tables) -> DataFrame:
    """Scored rows of every fold; the probabilities of a race add up to three places, or to its runners."""
    horses = ranked(t)[2].horses
    totals = horses.groupBy("race_id").agg(F.round(F.sum("p_top3"), 6).cast("bigint").alias("race_total"))
    return horses.join(totals, "race_id").select("race_id", "horse_no", "fold_id", "valid_year", *_POLICY, "race_total")


@query(
    "ranking_cv_pairs",
    f"""
    SELECT a.race_id, a.horse_no AS horse_no_1, b.horse_no AS horse_no_2, a.fold_id, a.valid_year, {_SLIDING}, true AS within_members
    FROM fold_valid a JOIN fold_valid b ON a.race_id = b.race_id AND a.horse_no < b.horse_no
    """,
    ["fold_valid"],
)
def ranking_cv_pairs(t: Tables) -> DataFrame:
    """Pairs of every fold; both in the first three is no likelier than either."""
    bound = F.col("p_wide") <= F.least("p_top3_1", "p_top3_2") + 1e-9
    return ranked(t)[2].pairs.select(
        "race_id", "horse_no_1", "horse_no_2", "fold_id", "valid_year", *_POLICY, (bound & (F.col("p_wide") >= 0)).alias("within_members")
    )


@query("ranking_cv_metrics")
def ranking_cv_metrics(t: Tables) -> DataFrame:
    return ranked(t)[2].metrics


@query("ranking_cv_segments")
def ranking_cv_segments(t: Tables) -> DataFrame:
    return ranked(t)[2].segments


@query("ranking_cv_models")
def ranking_cv_models(t: Tables) -> DataFrame:
    return ranked(t)[1]


_P3 = "least(greatest(p_top3, 1e-12), 1 - 1e-12)"


@query(
    "ranking_fold_metrics",
    f"""
    WITH top AS (SELECT race_id, horse_no, sum(prob) AS p_top3 FROM (
                     SELECT race_id, i AS horse_no, prob FROM triples
                     UNION ALL SELECT race_id, j, prob FROM triples UNION ALL SELECT race_id, k, prob FROM triples
                     UNION ALL SELECT race_id, horse_no, 1.0 FROM weighted WHERE n <= 3) GROUP BY ALL),
         loss AS (SELECT race_id, sum(nll) AS loss FROM suffix GROUP BY race_id),
         nll AS (SELECT fold_id, avg(loss) AS pl_nll FROM (SELECT DISTINCT fold_id, race_id FROM fold_valid) JOIN loss USING (race_id)
                 GROUP BY fold_id)
    SELECT fold_id, valid_year, count(*) AS rows, count(DISTINCT race_id) AS races, round(any_value(pl_nll), 5) AS pl_nll,
           round(avg(y), 6) AS base_rate, round(avg(-(CASE WHEN y = 1 THEN ln({_P3}) ELSE ln(1 - {_P3}) END)), 5) AS logloss,
           round(avg(pow(y - {_P3}, 2)), 5) AS brier
    FROM fold_valid JOIN top USING (race_id, horse_no) JOIN nll USING (fold_id) GROUP BY fold_id, valid_year
    """,
    ["fold_valid", "triples", "suffix"],
)
def ranking_fold_metrics(t: Tables) -> DataFrame:
    """Metrics of the folds with the tables' own score."""
    found = given_ranked(t).metrics
    return found.select(
        "fold_id", "valid_year", "rows", "races", *[F.round(c, d).alias(c) for c, d in (("pl_nll", 5), ("base_rate", 6), ("logloss", 5), ("brier", 5))]
    )


@query(
    "ranking_fold_segments",
    """
    SELECT fold_id, segment, count(*) AS n_rows, count(DISTINCT race_id) AS races, round(avg(y), 6) AS base_rate
    FROM (SELECT *, unnest(['all', CASE WHEN part % 2 = 1 THEN '3yo' ELSE '4up' END]) AS segment FROM fold_valid)
    GROUP BY fold_id, segment
    """,
    ["fold_valid"],
)
def ranking_fold_segments(t: Tables) -> DataFrame:
    found = given_ranked(t).segments
    return found.select("fold_id", "segment", "n_rows", "races", F.round("base_rate", 6).alias("base_rate"))


def given_ranked(t: Tables) -> train.Ranked:
    def make() -> train.Ranked:
        rows = given_predictions(t).filter("role = 'valid'").withColumn("pl_score", F.col("score"))
        return train.rank_rows(rows, holdout_year=HOLDOUT, years=3)

    return _once(t, "given_ranked", make)


_WEIGHTS = {"final3f_c": 0.5, "carried_weight": -0.25, "price": 0.75}


@query(
    "ranking_model_scores",
    f"""
    WITH filled AS (SELECT fold_id, coalesce(final3f_c, m) AS final3f_c, carried_weight, price
                    FROM fold_train JOIN (SELECT fold_id, median(final3f_c) AS m FROM fold_train GROUP BY fold_id) USING (fold_id)),
         moments AS (SELECT fold_id, {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _WEIGHTS)}
                     FROM filled GROUP BY fold_id),
         med AS (SELECT fold_id, median(final3f_c) AS m FROM fold_train GROUP BY fold_id)
    SELECT race_id, horse_no, fold_id, round(
           {" + ".join(f"{w} * ({'coalesce(final3f_c, m)' if c == 'final3f_c' else c} - a_{c}) / s_{c}" for c, w in _WEIGHTS.items())}, 6) AS pl_score
    FROM fold_valid JOIN moments USING (fold_id) JOIN med USING (fold_id)
    """,
    ["fold_train", "fold_valid"],
)
def ranking_model_scores(t: Tables) -> DataFrame:
    """A model table with the moments of each fold and given weights: written, read back and used for scoring."""
    rows = contract_rows(t)
    members = folds.fold_members(rows, _folds(rows))
    names = list(_WEIGHTS)
    stats = ranking.feature_stats_by(members.filter("role = 'train'"), names, "fold_id")
    weights = {f: (list(_WEIGHTS.values()), 0.0, True) for f, _, _ in folds.collect_folds(_folds(rows))}
    model = materialize(ranking.model_table(stats, weights, names, "fold_id"))
    scored = ranking.score_by(members.filter("role = 'valid'"), model, "fold_id")
    return scored.select("race_id", "horse_no", "fold_id", F.round("pl_score", 6).alias("pl_score"))


def holdout_ranked(t: Tables) -> train.Ranked:
    def make() -> train.Ranked:
        rows = ranked(t)[0]
        names = registry.ranking_features(rows.columns, profile="stack_default")
        model = train.fit_ranking_recent(rows, names, holdout_year=HOLDOUT)
        return train.rank_holdout_with(rows, model, holdout_year=HOLDOUT)

    return _once(t, "holdout_ranked", make)


@query(
    "ranking_holdout_pairs",
    f"""
    SELECT a.race_id, a.horse_no AS horse_no_1, b.horse_no AS horse_no_2, a.year AS valid_year, {_SLIDING}, true AS within_members
    FROM dated a JOIN dated b ON a.race_id = b.race_id AND a.horse_no < b.horse_no WHERE a.year >= 2001
    """,
    ["dated"],
)
def ranking_holdout_pairs(t: Tables) -> DataFrame:
    bound = F.col("p_wide") <= F.least("p_top3_1", "p_top3_2") + 1e-9
    return holdout_ranked(t).pairs.select(
        "race_id", "horse_no_1", "horse_no_2", "valid_year", *_POLICY, (bound & (F.col("p_wide") >= 0)).alias("within_members")
    )


@query("ranking_holdout_metrics")
def ranking_holdout_metrics(t: Tables) -> DataFrame:
    return holdout_ranked(t).metrics


# --- search ------------------------------------------------------------------

_POWERS = (1.0, 0.8, 1.25, 0.6, 1.6)


@query(
    "search_choice",
    f"""
    WITH trials AS (SELECT i AS trial, pow(p, [{", ".join(map(str, _POWERS))}][i + 1]) AS q, v.*
                    FROM fold_valid v, range({len(_POWERS)}) r(i)),
         bounded AS (SELECT *, least(greatest(q, 1e-12), 1 - 1e-12) AS b, least(greatest(q, 1e-6), 1 - 1e-6) AS e FROM trials),
         losses AS (SELECT trial, fold_id, avg(-(CASE WHEN y_win = 1 THEN ln(b) ELSE ln(1 - b) END)) AS logloss FROM bounded GROUP BY ALL),
         soft AS (SELECT *, (e / (1 - e)) / sum(e / (1 - e)) OVER (PARTITION BY trial, race_id) AS c FROM bounded),
         fit AS (SELECT trial, fold_id, 1 - sum(-ln(c)) / sum(ln(field_size)) AS r2 FROM soft WHERE y_win = 1 AND field_size > 1 GROUP BY ALL),
         trial_rows AS (SELECT trial, avg(logloss) AS mean_logloss, median(r2) AS r2_median, min(r2) AS r2_min, count(*) AS folds
                        FROM losses JOIN fit USING (trial, fold_id) GROUP BY trial),
         base AS (SELECT r2_median AS m, r2_min AS l FROM trial_rows WHERE trial = 0),
         near AS (SELECT trial_rows.* FROM trial_rows, base WHERE r2_median >= m - 0.002 AND r2_min >= l - 0.01)
    SELECT trial, round(mean_logloss, 6) AS mean_logloss, round(r2_median, 5) AS r2_median, round(r2_min, 5) AS r2_min, folds,
           trial = (SELECT trial FROM near ORDER BY mean_logloss, trial LIMIT 1) AS chosen
    FROM trial_rows
    """,
    ["fold_valid"],
)
def search_choice(t: Tables) -> DataFrame:
    """Trials that raise the tables' probability to a power: metrics in one pass, then the choice near trial 0."""
    rows = given_predictions(t).filter("role = 'valid'").withColumn("best_round", F.lit(None).cast("int"))
    powers = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(x).alias("power")) for i, x in enumerate(_POWERS)])
    trials = rows.select("*", F.inline(powers)).withColumn("q", F.pow("p", "power"))
    table = materialize(train.trial_table(trials, "y_win", "q", y_win="y_win"))
    first = table.filter("trial = 0").select("r2_median", "r2_min").first()
    best = selection.best_trial(table, task="win", baseline_median=first["r2_median"], baseline_min=first["r2_min"])
    chosen = table.join(best.select("trial", F.lit(True).alias("chosen")), "trial", "left")
    return chosen.select(
        F.col("trial").cast("bigint").alias("trial"), F.round("mean_logloss", 6).alias("mean_logloss"),
        F.round("r2_median", 5).alias("r2_median"), F.round("r2_min", 5).alias("r2_min"), "folds",
        F.coalesce("chosen", F.lit(False)).alias("chosen"),
    )


@query("search_best")
def search_best(t: Tables) -> DataFrame:
    """The chosen one of twelve parameter sets of the logistic learner for the win task."""
    rows = contract_rows(t)
    grid = [{"penalty": p, "rounds": n} for p in (1e-4, 1e-3, 1e-2, 1e-1) for n in (20, 50, 100)]
    trials = _once(
        t, "trials", lambda: materialize(train.search_trials(rows, _folds(rows), "logistic", training.FEATURES, "y_win", grid, y_win="y_win"))
    )
    first = trials.filter("trial = 0").select("r2_median", "r2_min").first()
    return selection.best_trial(trials, task="win", baseline_median=first["r2_median"], baseline_min=first["r2_min"])


# --- metrics rows of a run ---------------------------------------------------


@query(
    "run_metrics_rows",
    """
    SELECT 'given' AS run_id, 'fold_' || fold_id AS section, key, round(value, 6) AS value FROM (
        SELECT fold_id, count(*)::DOUBLE AS rows, avg(y) AS base_rate FROM fold_valid GROUP BY fold_id)
    UNPIVOT (value FOR key IN (rows, base_rate))
    """,
    ["fold_valid"],
)
def run_metrics_rows(t: Tables) -> DataFrame:
    """Fold metrics as the rows that runs are compared by."""
    found = metrics.binary_metrics(given_predictions(t).filter("role = 'valid'"), "y", "p", by=["fold_id"])
    parts = [
        selection.metrics_rows(found.filter(F.col("fold_id") == f), "given", f"fold_{f}", {"n_rows": "rows", "base_rate": "base_rate"})
        for f, _, _ in folds.collect_folds(_folds(contract_rows(t)))
    ]
    return filters.concat_folds(parts).withColumn("value", F.round("value", 6))
