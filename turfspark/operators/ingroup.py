"""Values of a runner relative to its race.

With `bounded` the caller vouches for small groups (a race of the target segment
has at most 18 runners, by its filter and key): a plain window is then one
shuffle for all values. Without it, sums are aggregated and joined back and
ranks go through the splitting running sum, so a group may be of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfspark.functions import market as M
from turfspark.functions import scalars as S
from turfspark.operators import skew

RACE = ("race_id",)


def _attach(df: DataFrame, keys: Sequence[str], bounded: bool, **values: Column) -> DataFrame:
    if not bounded:
        return skew.attach_group(df, keys, **values)
    group = Window.partitionBy(*keys)
    return df.withColumns({name: value.over(group) for name, value in values.items()})


def add_zscores(
    df: DataFrame, outputs: dict[str, str], keys: Sequence[str] = RACE, *, bounded: bool = False
) -> DataFrame:
    """`outputs` maps value column to z-score column; equal values in a group score 0."""
    stats = {}
    for i, value in enumerate(outputs):
        stats[f"_m{i}"] = F.avg(value)
        stats[f"_s{i}"] = F.stddev_pop(value)
    out = _attach(df, keys, bounded, **stats)
    scores = {}
    for i, (value, name) in enumerate(outputs.items()):
        centred = F.col(value) - F.col(f"_m{i}")
        scores[name] = F.when(F.col(value).isNull(), F.lit(None)).when(
            F.col(f"_s{i}") == 0, F.lit(0.0)
        ).otherwise(centred / F.col(f"_s{i}"))
    return out.withColumns(scores).drop(*stats)


def add_centered(
    df: DataFrame, outputs: dict[str, str], keys: Sequence[str] = RACE, *, bounded: bool = False
) -> DataFrame:
    stats = {f"_m{i}": F.avg(value) for i, value in enumerate(outputs)}
    out = _attach(df, keys, bounded, **stats)
    return out.withColumns(
        {name: F.col(value) - F.col(f"_m{i}") for i, (value, name) in enumerate(outputs.items())}
    ).drop(*stats)


def add_rank(
    df: DataFrame,
    value: str,
    *,
    rank: str | None = None,
    pct: str | None = None,
    descending: bool = False,
    keys: Sequence[str] = RACE,
    limit: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Rank with ties averaged, and the same divided by the number of non-null values."""
    if bounded:
        order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
        group = Window.partitionBy(*keys)
        ties = F.count(value).over(group.orderBy(order).rangeBetween(Window.currentRow, Window.currentRow))
        place = F.rank().over(group.orderBy(order)) + (ties - 1) / 2.0
        out = df.withColumns(
            {"_rank": F.when(F.col(value).isNotNull(), place), "_count": F.count(value).over(group)}
        )
    else:
        ranks = skew.average_rank(df, keys, value, descending=descending, limit=limit)
        out = df.join(ranks, [*keys, value], "left")
    if rank:
        out = out.withColumn(rank, F.col("_rank"))
    if pct:
        out = out.withColumn(pct, F.col("_rank") / F.col("_count"))
    return out.drop("_rank", "_count")


def add_share(df: DataFrame, flag: str, count: str, share: str, *, bounded: bool = False) -> DataFrame:
    """Number of flagged runners in the race and their share of the field size."""
    out = _attach(df, RACE, bounded, **{count: F.sum(flag)})
    field = S.number(F.col("field_size"))
    return out.withColumn(share, F.col(count) / F.when(field != 0, field))


def add_implied(
    df: DataFrame, odds: str, norm: str, *, raw: str | None = None, keys: Sequence[str] = RACE
) -> DataFrame:
    """Implied probability of the odds, normalised to sum to one over the race."""
    priced = df.withColumn("_implied", M.implied(S.number(F.col(odds))))
    out = skew.attach_group(priced, keys, _total=F.sum("_implied"))
    out = out.withColumn(norm, F.when(F.col("_total") > 0, F.col("_implied") / F.col("_total")))
    if raw:
        out = out.withColumn(raw, F.col("_implied"))
    return out.drop("_implied", "_total")


def add_softmax(
    df: DataFrame, score: str, output: str, beta: float = 1.0, keys: Sequence[str] = RACE
) -> DataFrame:
    """Softmax of beta * score per race, shifted by the race maximum; null scores stay null."""
    if not beta > 0:
        raise ValueError("beta must be positive")
    finite = S.number(F.col(score))
    top = skew.attach_group(df.withColumn("_s", finite * beta), keys, _top=F.max("_s"))
    powered = top.withColumn("_e", F.exp(F.col("_s") - F.col("_top")))
    out = skew.attach_group(powered, keys, _sum=F.sum("_e"))
    return out.withColumn(output, F.col("_e") / F.col("_sum")).drop("_s", "_top", "_e", "_sum")
