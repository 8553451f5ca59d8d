"""Ranking inputs and fits move each row once, whatever the number of folds and steps."""

import numpy as np
from pyspark.sql import functions as F

from turfspark.operators import ranking
from turfspark.plans import features


def _races(spark, races=60, field=5):
    rng = np.random.default_rng(3)
    rows = [
        (race, no, int(place) + 1, float(rng.normal()) - 0.3 * int(place), None if rng.random() < 0.1 else float(rng.integers(0, 4)))
        for race in range(races)
        for no, place in enumerate(rng.permutation(field), 1)
    ]
    return spark.createDataFrame(rows, "race_id long, horse_no long, finish_pos long, a double, b double")


def test_fit_by_lists_of_groups_equals_single_fits(spark):
    df = _races(spark)
    lists = F.when(F.col("race_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    listed = df.withColumn("fold", lists).persist()
    members = listed.withColumn("fold", F.explode("fold"))
    stats = {}
    for row in ranking.feature_stats_by(members, ["a", "b"], "fold").collect():
        stats.setdefault(row["fold"], {})[row["feature"]] = row
    rows = {k: [own["a"], own["b"]] for k, own in stats.items()}
    for fold, own in rows.items():
        values = [r["b"] for r in members.filter(F.col("fold") == fold).collect()]
        middle = np.median([v for v in values if v is not None])
        filled = [middle if v is None else v for v in values]
        assert np.allclose([own[1]["median"], own[1]["mean"], own[1]["std"]], [middle, np.mean(filled), np.std(filled)])
    together = ranking.fit_pl_by(listed, ["a", "b"], "fold", moments=rows)
    apart = ranking.fit_pl_by(ranking.standardize_by(members, rows, "fold"), ["a", "b"], "fold")
    assert set(together) == set(apart) == {1, 2}
    for fold in (1, 2):
        assert np.allclose(together[fold][0], apart[fold][0], atol=1e-9) and abs(together[fold][1] - apart[fold][1]) < 1e-9


def test_ranking_inputs_take_one_shuffle(spark):
    rows = _races(spark).select(
        "race_id", "horse_no", F.lit(0.4).alias("p_win_stack"), F.lit(0.5).alias("p_place_stack"),
        F.col("a").alias("place_width_log_ratio"), F.lit(5).alias("field_size"), F.lit(1600).alias("distance_m"),
        F.lit(1).alias("is_3yo"), F.lit(0.5).alias("share_3yo_in_race"),
    )
    plan = features.ranking_interactions(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_probabilities_of_a_race_without_lambdas(spark):
    """Races are computed together, and a runner without a number is no pair with itself."""
    rows = [(1, no, s) for no, s in zip([1, 2, None, 4, 5], [0.3, 0.1, -0.2, 1.4, 0.0], strict=True)]
    rows += [(2, no, 0.1 * no) for no in range(1, 19)]
    df = spark.createDataFrame(rows, "race_id long, horse_no int, s double")
    single = ranking.top3_probabilities(df, "s")
    pair = ranking.pair_probabilities(df, "s")
    for frame in (single, pair):
        assert "lambda" not in frame._jdf.queryExecution().optimizedPlan().toString()
    sums = {r.race_id: r.total for r in single.groupBy("race_id").agg(F.sum("p_top3").alias("total")).collect()}
    assert np.allclose([sums[1], sums[2]], 3.0)
    sums = {r.race_id: (r.n, r.total) for r in pair.groupBy("race_id").agg(F.count("*").alias("n"), F.sum("p_wide").alias("total")).collect()}
    assert sums[1][0] == 10 and sums[2][0] == 153 and np.allclose([sums[1][1], sums[2][1]], 3.0)
