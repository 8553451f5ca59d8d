"""Model selection over tables of trials, and comparison of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark import constants as C


def lowest_logloss(trials: DataFrame) -> DataFrame:
    """The completed trial with the lowest mean log-loss; the lower number wins a tie."""
    done = trials.filter((F.col("state") == "COMPLETE") & F.col("mean_logloss").isNotNull())
    order = F.struct("mean_logloss", "trial")
    best = F.min_by(F.struct(*[F.col(c) for c in trials.columns]), order)
    return done.agg(best.alias("_b")).filter("_b is not null").select("_b.*")


def best_trial(
    trials: DataFrame,
    *,
    task: str,
    baseline_median: float | None = None,
    baseline_min: float | None = None,
    fallback_trial: int | None = None,
) -> DataFrame:
    """Best trial and the rule that chose it.

    For the win task only trials whose pseudo-R² stays near the baseline count;
    when none does, the fallback trial is taken, else the lowest log-loss.
    """
    plain = lambda rule: lowest_logloss(trials).withColumn("rule", F.lit(rule))
    if task == "place":
        return plain("min_complete")
    choices = []
    if baseline_median is not None and baseline_min is not None:
        near = trials.filter(
            (F.col("r2_median") >= baseline_median - C.WIN_R2_MEDIAN_TOLERANCE)
            & (F.col("r2_min") >= baseline_min - C.WIN_R2_MIN_TOLERANCE)
        )
        choices.append(lowest_logloss(near).withColumn("rule", F.lit("constrained_logloss")))
    if fallback_trial is not None:
        named = trials.filter((F.col("state") == "COMPLETE") & (F.col("trial") == fallback_trial))
        choices.append(named.withColumn("rule", F.lit("study_best_fallback")))
    choices.append(plain("min_complete_fallback"))
    ranked = None
    for rank, choice in enumerate(choices):
        part = choice.withColumn("_rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part)
    columns = [*trials.columns, "rule"]
    first = ranked.agg(F.min_by(F.struct(*columns), F.col("_rank")).alias("_b"))
    return first.filter("_b is not null").select("_b.*")


def flatten_json(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Numbers of a nested JSON document as rows (keys, key, value), keys joined by dots.

    Lists, texts and booleans are skipped. Nesting is followed to the depth met in
    the data, one pass per level.
    """
    kind = "map<string,variant>"
    level = df.select(
        *keys, F.lit("").alias("_prefix"), F.try_parse_json(column).alias("_node")
    )
    out = None
    while True:
        opened = level.select(
            *keys,
            "_prefix",
            F.explode(F.try_variant_get("_node", "$", kind)).alias("_name", "_child"),
        ).withColumn(
            "key",
            F.when(F.col("_prefix") == "", F.col("_name")).otherwise(
                F.concat_ws(".", "_prefix", "_name")
            ),
        )
        shape = F.schema_of_variant("_child")
        numbers = opened.filter(
            shape.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
            | shape.startswith("DECIMAL")
        ).select(*keys, "key", F.variant_get("_child", "$", "double").alias("value"))
        out = numbers if out is None else out.unionByName(numbers)
        level = opened.filter(shape.startswith("OBJECT")).select(
            *keys, F.col("key").alias("_prefix"), F.col("_child").alias("_node")
        )
        if level.isEmpty():
            return out


def compare_runs(metrics: DataFrame, left: str, right: str) -> DataFrame:
    """Metrics both runs have: left, right and right minus left."""
    side = lambda run, name: metrics.filter(F.col("run_id") == run).select(
        "section", "key", F.col("value").alias(name)
    )
    return (
        side(left, "left_value")
        .join(side(right, "right_value"), ["section", "key"])
        .withColumn("delta", F.col("right_value") - F.col("left_value"))
    )


def metrics_rows(df: DataFrame, run: str, section: str, columns: Mapping[str, str]) -> DataFrame:
    """Wide one-row metrics to long rows; `columns` maps column to metric name."""
    typed = df.select(*[F.col(c).cast("double").alias(n) for c, n in columns.items()])
    long = typed.unpivot([], list(columns.values()), "key", "value")
    return long.select(F.lit(run).alias("run_id"), F.lit(section).alias("section"), "key", "value")
