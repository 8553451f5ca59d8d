"""Joins of base tables, snapshots, predictions and labels."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark import constants as C
from turfspark.functions import scalars as S
from turfspark.operators import filters, quality

RUNNER = ["race_id", "horse_no"]


def base_rows(race: DataFrame, runner: DataFrame, result: DataFrame, from_date, to_date) -> DataFrame:
    """race ⋈ runner ⋈ result of central tracks in a date range, with post time and buckets."""
    scope = filters.date_window(race, from_date, to_date).filter(
        F.col("track_code").between(*C.CENTRAL_TRACKS)
    )
    rows = scope.join(runner, "race_id").join(result, ["race_id", "horse_id"])
    start = S.start_seconds(F.coalesce(F.col("start_time").cast("string"), F.lit("")))
    return rows.withColumns(
        {
            "race_datetime": S.post_time(F.col("race_date"), start),
            "distance_bucket": S.distance_bucket(F.col("distance_m")),
            "going_bucket": S.going_bucket(F.col("going")),
        }
    )


def finish_positions(runner: DataFrame, result: DataFrame, races: DataFrame) -> DataFrame:
    keyed = filters.in_keys(runner.select("race_id", "horse_id", "horse_no"), races)
    return keyed.join(
        result.select("race_id", "horse_id", "finish_pos"), ["race_id", "horse_id"]
    ).select(*RUNNER, "finish_pos")


def top3(finish: DataFrame) -> DataFrame:
    return finish.filter("finish_pos <= 3").select(*RUNNER)


def label_pairs(pair: DataFrame, first_three: DataFrame) -> DataFrame:
    """`y_wide` = both members finished in the first three (two left joins)."""
    one = first_three.select("race_id", F.col("horse_no").alias("horse_no_1"), F.lit(1).alias("_a"))
    two = first_three.select("race_id", F.col("horse_no").alias("horse_no_2"), F.lit(1).alias("_b"))
    joined = pair.join(one, ["race_id", "horse_no_1"], "left").join(
        two, ["race_id", "horse_no_2"], "left"
    )
    hit = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.withColumn("y_wide", hit.cast("int")).drop("_a", "_b")


def key_violations(left: DataFrame, right: DataFrame, on: Sequence[str], *, total: bool = True) -> DataFrame:
    """(rule, left_rows, right_rows, keys) of the keys that break a one-to-one join, one row per key.

    Rules: repeated left key, repeated right key, and (with `total`) a left row without a match. Both sides are
    counted in one aggregate over narrow rows; null keys never match, so they are rows without a match.
    """
    side = lambda df, one, two: df.select(*on, F.lit(one).alias("_l"), F.lit(two).alias("_r"))
    counts = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*on).agg(
        F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows")
    )
    no_key = F.lit(False)
    for key in on:
        no_key = no_key | F.col(key).isNull()
    unmatched = (F.col("left_rows") > 0) & ((F.col("right_rows") == 0) | no_key)
    rules = [
        F.when((F.col("left_rows") > 1) & ~no_key, F.lit("repeated left key")),
        F.when((F.col("right_rows") > 1) & ~no_key, F.lit("repeated right key")),
        F.when(unmatched, F.lit("row without a match")) if total else F.lit(None).cast("string"),
    ]
    broken = F.filter(F.array(*rules), lambda rule: rule.isNotNull())
    return counts.select(F.explode(broken).alias("rule"), *on, "left_rows", "right_rows")


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], *, label: str = "join") -> DataFrame:
    """Left join after checking, in one pass, that keys are unique on both sides and no left row is without a match."""
    quality.require_empty(key_violations(left, right, on), label)
    return left.join(right, list(on), "left")


def add_predictions(
    df: DataFrame, predictions: Mapping[str, DataFrame], on: Sequence[str] = RUNNER, *, check: bool = True
) -> DataFrame:
    """Left-join one prediction column per input; repeated keys are refused."""
    out = df
    for column, frame in predictions.items():
        slim = frame.select(*on, column)
        if check:
            quality.require_empty(quality.duplicate_keys(slim, on), f"{column}: repeated key")
        out = out.join(slim, list(on), "left")
    return out


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def add_columns_like(
    df: DataFrame, extra: DataFrame, pattern: str, on: Sequence[str] = RUNNER
) -> DataFrame:
    """Left-join the columns of `extra` whose names match a pattern.

    Columns that `df` has already stay as they are. A repeated key in `extra` is refused.
    """
    names = [c for c in columns_like(extra, pattern) if c not in on and c not in df.columns]
    if not names:
        return df
    slim = extra.select(*on, *names)
    quality.require_empty(quality.duplicate_keys(slim, on), f"columns like {pattern}: repeated key")
    return df.join(slim, list(on), "left")


def carry_race_values(detail: DataFrame, source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Race-level constants of `source` onto detail rows."""
    values = source.groupBy("race_id").agg(*[F.min(c).alias(c) for c in columns])
    return detail.join(values, "race_id", "left")
