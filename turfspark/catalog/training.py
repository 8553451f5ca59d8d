"""Models over year folds, calibration and the ranking layer, trained on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark.catalog.base import Tables, query
from turfspark.operators import calibrate, filters, folds, ingroup, joins, metrics, ranking, train
from turfspark.plans import features, registry
from turfspark.session import stored

HOLDOUT = 2001
FEATURES = ["carried_weight", "price", "distance_m", "going", "final3f_c"]


def model_rows(t: Tables) -> DataFrame:
    rows = t.scored.join(t.race.select("race_id", "race_date", "distance_m", "going"), "race_id")
    return stored(rows.withColumn("year", F.year("race_date")))


def _folds(rows: DataFrame) -> DataFrame:
    return folds.year_folds(folds.years_of(rows, "year"), HOLDOUT)


def _oof(rows: DataFrame, learner: str, prepared: dict[int, train.Prepared] | None = None) -> DataFrame:
    return train.cross_validate(rows, _folds(rows), learner, FEATURES, "y", f"p_{learner}", holdout_year=HOLDOUT, prepared=prepared)


@query("gbt_oof")
def gbt_oof(t: Tables) -> DataFrame:
    rows = model_rows(t)
    return _oof(rows, "gbt").select("race_id", "horse_no", "y", "fold_id", "valid_year", F.round("p_gbt", 6).alias("p_gbt"))


@query("oof_fold_metrics")
def oof_fold_metrics(t: Tables) -> DataFrame:
    return train.fold_metrics(stored(_oof(model_rows(t), "logistic")), "y", "p_logistic")


@query("stacker_oof")
def stacker_oof(t: Tables) -> DataFrame:
    rows = model_rows(t)
    prepared: dict[int, train.Prepared] = {}
    inputs = {f"p_{n}": stored(_oof(rows, n, prepared)) for n in ("gbt", "forest", "logistic")}
    stacked = train.stack(
        rows, inputs, [*inputs, "distance_m", "going"], "y", "p_stack", holdout_year=HOLDOUT, name="logistic"
    )
    return stacked.select("race_id", "horse_no", "fold_id", "valid_year", F.round("p_stack", 6).alias("p_stack"))


@query("final_and_holdout")
def final_and_holdout(t: Tables) -> DataFrame:
    rows = model_rows(t)
    models = train.final_fits(
        rows, folds.years_of(rows, "year"), HOLDOUT, "logistic", FEATURES, "y"
    )
    late = filters.holdout(rows, HOLDOUT)
    parts = [
        train.predict_binary(model, late, FEATURES, "p_hat").select(
            F.lit(name).alias("model"), "race_id", "horse_no", F.round("p_hat", 6).alias("p_hat")
        )
        for name, model in models.items()
    ]
    return parts[0].unionByName(parts[1])


@query("parameter_search")
def parameter_search(t: Tables) -> DataFrame:
    rows = model_rows(t)
    grid = [{"penalty": p, "rounds": n} for p in (1e-4, 1e-3, 1e-2, 1e-1) for n in (20, 50, 100)]
    trials = train.search_trials(rows, _folds(rows), "logistic", FEATURES, "y", grid)
    return trials.select("trial", "state", "mean_logloss", "params")


def _ranking_inputs(t: Tables) -> DataFrame:
    rows = model_rows(t).withColumns(
        {
            "p_win_stack": F.col("p"),
            "p_place_stack": F.sqrt("p"),
            "place_width_log_ratio": F.log1p("price") / 10,
            "is_3yo": (F.col("part") % 2).cast("int"),
        }
    )
    return features.ranking_interactions(ingroup.add_share(rows, "is_3yo", "n_3yo_in_race", "share_3yo_in_race", bounded=True))


@query(
    "ranking_interactions",
    """
    SELECT race_id, horse_no, round(z * z2, 5) AS z_win_stack_x_z_place_stack, round(z * field_size, 5) AS z_win_stack_x_field_size,
           round(z - avg(z) OVER (PARTITION BY race_id), 5) AS z_win_stack_race_centered
    FROM (SELECT *, ln(p / (1 - p)) AS z, ln(sqrt(p) / (1 - sqrt(p))) AS z2 FROM scored)
    """,
    ["scored"],
)
def ranking_interactions(t: Tables) -> DataFrame:
    names = ["z_win_stack_x_z_place_stack", "z_win_stack_x_field_size", "z_win_stack_race_centered"]
    return _ranking_inputs(t).select("race_id", "horse_no", *[F.round(n, 5).alias(n) for n in names])


@query("pl_fit_score")
def pl_fit_score(t: Tables) -> DataFrame:
    rows = stored(_ranking_inputs(t))
    names = registry.ranking_features(rows.columns, profile="stack_default")
    scored = train.rank_holdout(rows, names, holdout_year=HOLDOUT)
    return scored.select("race_id", "horse_no", F.round("pl_score", 4).alias("pl_score"))


def _raw_pairs(t: Tables) -> DataFrame:
    pair = ranking.pair_probabilities(t.scored, "score").withColumnRenamed("p_wide", "p_wide_raw")
    labelled = joins.label_pairs(pair, joins.top3(t.runner))
    return stored(labelled.join(t.race.select("race_id", F.year("race_date").alias("year")), "race_id"))


def _calibrated(t: Tables, method: str) -> DataFrame:
    pairs = _raw_pairs(t)
    _, _, late = calibrate.fit_and_apply(
        pairs.filter(F.col("year") < HOLDOUT), pairs.filter(F.col("year") >= HOLDOUT), method=method
    )
    return late


@query("isotonic_calibration")
def isotonic_calibration(t: Tables) -> DataFrame:
    return _calibrated(t, "isotonic").select("race_id", "kumiban", F.round("p_wide", 6).alias("p_wide"))


@query("logistic_calibration")
def logistic_calibration(t: Tables) -> DataFrame:
    return _calibrated(t, "logreg").select("race_id", "kumiban", F.round("p_wide", 6).alias("p_wide"))


@query("calibration_fit_and_holdout")
def calibration_fit_and_holdout(t: Tables) -> DataFrame:
    pairs = _raw_pairs(t)
    _, early, late = calibrate.fit_and_apply(
        pairs.filter(F.col("year") < HOLDOUT), pairs.filter(F.col("year") >= HOLDOUT)
    )
    parts = [
        metrics.overall_calibration(frame, column, "y_wide").withColumns({"rows": F.lit(name), "score": F.lit(column)})
        for name, frame in (("fit", early), ("holdout", late))
        for column in ("p_wide_raw", "p_wide")
    ]
    return filters.concat_folds(parts)


@query(
    "constant_calibration",
    "SELECT race_id, kumiban, round((SELECT avg(y_wide) FROM pair), 6) AS p_wide FROM pair",
    ["pair"],
)
def constant_calibration(t: Tables) -> DataFrame:
    flat = t.pair.withColumn("p_wide_raw", F.lit(0.5))
    fitted = calibrate.fit_calibrator(flat, "p_wide_raw", "y_wide")
    return calibrate.apply_calibrator(flat.drop("p_wide"), fitted).select("race_id", "kumiban", F.round("p_wide", 6).alias("p_wide"))
