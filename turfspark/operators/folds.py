"""Year folds, their checks, and the columns that record the policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark import constants as C


def years_of(df: DataFrame, column: str = "race_date") -> DataFrame:
    """Distinct years, from a date column or from a year column."""
    kind = dict(df.dtypes)[column]
    value = F.col(column).cast("int") if kind in ("int", "bigint", "smallint") else F.year(column)
    return df.select(value.alias("year")).filter(F.col("year").isNotNull()).distinct()


def year_folds(
    years: DataFrame,
    holdout_year: int,
    *,
    least: int = C.TRAIN_WINDOW_YEARS,
    most: int | None = None,
) -> DataFrame:
    """(fold_id, valid_year, train_years): each year validated on the years before it.

    A fold needs `least` earlier years and trains on the last `most` of them
    (the same number by default: a sliding window of fixed length). The years
    are few; they are numbered within one array.
    """
    most = least if most is None else most
    if least <= 0 or most < least:
        raise ValueError("need 0 < least <= most")
    usable = years.filter(F.col("year") < holdout_year).agg(
        F.sort_array(F.collect_set("year")).alias("_years")
    )
    at = usable.select("_years", F.posexplode("_years").alias("_at", "valid_year"))
    window = F.least(F.lit(most), F.col("_at"))
    return at.filter(F.col("_at") >= least).select(
        (F.col("_at") - least + 1).alias("fold_id"),
        F.col("valid_year"),
        F.slice("_years", F.col("_at") - window + 1, window).alias("train_years"),
    )


def stacker_folds(years: DataFrame, holdout_year: int) -> DataFrame:
    return year_folds(years, holdout_year, least=C.STACKER_MIN_YEARS, most=C.STACKER_MAX_YEARS)


def recent_years(years: DataFrame, count: int = C.TRAIN_WINDOW_YEARS, holdout_year: int | None = None):
    usable = years if holdout_year is None else years.filter(F.col("year") < holdout_year)
    return usable.orderBy(F.col("year").desc()).limit(count)


def collect_folds(folds: DataFrame) -> list[tuple[int, list[int], int]]:
    """Folds as plain values for the loop over fits: one entry per year."""
    rows = folds.orderBy("fold_id").collect()
    return [(r["fold_id"], list(r["train_years"]), r["valid_year"]) for r in rows]


def fold_members(df: DataFrame, folds: DataFrame, year: str = "year") -> DataFrame:
    """Every row once per fold it belongs to, with `role` train or valid."""
    train = folds.select("fold_id", F.explode("train_years").alias("_y"), F.lit("train").alias("role"))
    valid = folds.select("fold_id", F.col("valid_year").alias("_y"), F.lit("valid").alias("role"))
    return df.join(train.unionByName(valid), F.col(year) == F.col("_y")).drop("_y")


def integrity_violations(train: DataFrame, valid: DataFrame, valid_year: int) -> DataFrame:
    """Rule broken and number of offenders; empty when the fold is clean."""
    late = train.filter(F.col("year") >= valid_year).agg(
        F.lit("train year not before valid year").alias("rule"), F.count(F.lit(1)).alias("rows")
    )
    shared = (
        train.select("race_id")
        .intersect(valid.select("race_id"))
        .agg(F.lit("race in train and valid").alias("rule"), F.count(F.lit(1)).alias("rows"))
    )
    return late.unionByName(shared).filter("rows > 0")


def window_text(years: int = C.TRAIN_WINDOW_YEARS) -> str:
    # fixed values: text stored with every prediction
    return f"train = previous {years} years only, valid = current year"


def capped_window_text(least: int = C.STACKER_MIN_YEARS, most: int = C.STACKER_MAX_YEARS) -> str:
    # fixed values: text stored with every prediction
    return f"train = capped expanding years (min={least}, max={most}), valid = next year"


def attach_policy(
    df: DataFrame,
    holdout_year: int,
    *,
    years: int = C.TRAIN_WINDOW_YEARS,
    policy: str = "fixed_sliding",
    text: str | None = None,
) -> DataFrame:
    return df.withColumns(
        {
            "cv_window_policy": F.lit(policy),
            "train_window_years": F.lit(years),
            "holdout_year": F.lit(holdout_year),
            "window_definition": F.lit(text or window_text(years)),
        }
    )


def common_years(frames: Sequence[DataFrame], column: str = "valid_year") -> DataFrame:
    """Years present in all inputs."""
    out = years_of(frames[0], column)
    for frame in frames[1:]:
        out = out.intersect(years_of(frame, column))
    return out


def missing_years(required: DataFrame, available: DataFrame) -> DataFrame:
    return required.join(available, "year", "left_anti")


def select_years(
    df: DataFrame,
    *,
    holdout_year: int | None = None,
    years: Sequence[int] = (),
    required: Sequence[int] = (),
    column: str = "valid_year",
) -> DataFrame:
    """Rows of the wanted years before the holdout; raises when a wanted year is absent."""
    base = df if holdout_year is None else df.filter(F.col(column) < holdout_year)
    wanted = sorted(set(years) | set(required))
    if wanted:
        present = base.filter(F.col(column).isin(wanted)).select(column).distinct()
        absent = sorted(set(wanted) - {row[0] for row in present.collect()})
        if absent:
            raise ValueError(f"years not in the input: {absent}")
    return base.filter(F.col(column).isin(list(years))) if years else base


def year_coverage(
    base_years: DataFrame, stacker_years: DataFrame, holdout_year: int, window: int = C.TRAIN_WINDOW_YEARS
) -> DataFrame:
    """One row: years available to each layer and whether the ranking layer has any fold."""
    listed = lambda df, name: df.agg(F.sort_array(F.collect_set("year")).alias(name))
    eligible = base_years.intersect(stacker_years).filter(F.col("year") < holdout_year)
    folds = year_folds(eligible, holdout_year, least=window)
    valid = folds.select(F.col("valid_year").alias("year"))
    one = lambda df, name: listed(df, name).withColumn("_one", F.lit(1))
    out = (
        one(base_years, "base_oof_years")
        .join(one(stacker_years, "stacker_oof_years"), "_one")
        .join(one(eligible, "pl_eligible_years"), "_one")
        .join(one(valid, "pl_oof_valid_years"), "_one")
        .drop("_one")
    )
    return out.withColumn("feasible", F.size("pl_oof_valid_years") > 0)
