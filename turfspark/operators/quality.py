"""Data checks. Each returns the offending rows; an empty frame means the rule holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfspark.functions import scalars as S
from turfspark.operators import skew


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def require_columns(df: DataFrame, columns: Sequence[str], label: str) -> None:
    """Schema check: no job is run."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{label}: missing columns {missing}")


def require_empty(violations: DataFrame, label: str, *, sample: int = 5) -> None:
    """Raise with a few examples when a check found something."""
    rows = violations.limit(sample).collect()
    if rows:
        raise ValueError(f"{label}: {[r.asDict() for r in rows]}")


def future_references(df: DataFrame, pairs: Sequence[tuple[str, str]], *, strict: bool = False) -> DataFrame:
    """Rows where an input is newer than its cut-off (or not older, with `strict`)."""
    broken = F.lit(False)
    for seen, cut in pairs:
        late = F.col(seen) >= F.col(cut) if strict else F.col(seen) > F.col(cut)
        broken = broken | F.coalesce(late, F.lit(False))
    return df.filter(broken)


def unsorted_rows(
    spark: SparkSession, path: str, keys: Sequence[str] = ("race_id", "horse_no")
) -> DataFrame:
    """Rows of a stored Parquet dataset that come before their predecessor in the same file.

    The row index of the file gives the order; one file is the unit of work.
    """
    stored = spark.read.parquet(path).select(
        *keys,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    before = F.lag(F.struct(*keys)).over(Window.partitionBy("_file").orderBy("_row"))
    return stored.withColumn("_before", before).filter(
        F.struct(*keys) < F.col("_before")
    ).select(*keys)


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child keys without a parent row."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def orphan_counts(
    links: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]],
) -> DataFrame:
    """(link, orphans) for several foreign keys."""
    out = None
    for name, (child, parent, keys) in links.items():
        known = child.dropna(subset=list(keys))
        part = orphans(known, parent, keys).agg(
            F.lit(name).alias("link"), F.count(F.lit(1)).alias("orphans")
        )
        out = part if out is None else out.unionByName(part)
    return out


def not_constant(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column) pairs with more than one known value within the key.

    Smallest and largest value are compared: no distinct values are shuffled.
    """
    changing = F.array(
        *[F.when(F.min(c) < F.max(c), F.lit(c)) for c in columns]
    )
    return (
        df.groupBy(key)
        .agg(F.filter(changing, lambda name: name.isNotNull()).alias("_c"))
        .select(key, F.explode("_c").alias("column"))
    )


def pair_violations(df: DataFrame) -> DataFrame:
    """Pair rows that break a rule of the pair input, with the rule broken."""
    one, two = F.col("horse_no_1"), F.col("horse_no_2")
    p = S.number(F.col("p_wide"))
    key = F.trim(F.coalesce(F.col("kumiban"), F.lit("")))
    rules: dict[str, Column] = {
        "probability missing": p.isNull(),
        "probability outside [0, 1]": (p < 0) | (p > 1),
        "members equal": one == two,
        "key does not match members": (key != "") & (key != S.pair_key(one, two)),
    }
    found = F.filter(
        F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(n)) for n, rule in rules.items()]),
        lambda name: name.isNotNull(),
    )
    broken = df.withColumn("rule", F.explode(found))
    low, high = F.least(one, two).alias("horse_no_1"), F.greatest(one, two).alias("horse_no_2")
    repeated = skew.attach_group(
        df.select("race_id", low, high, "kumiban"), ["race_id", "horse_no_1", "horse_no_2"],
        _rows=F.count(F.lit(1)),
    ).filter("_rows > 1")
    columns = ["race_id", "horse_no_1", "horse_no_2", "kumiban", "rule"]
    return broken.select(*columns).unionByName(
        repeated.withColumn("rule", F.lit("pair repeated")).select(*columns)
    )


def clean_pairs(df: DataFrame) -> DataFrame:
    """Pair rows with ordered members, filled key and numeric probability."""
    one, two = F.col("horse_no_1"), F.col("horse_no_2")
    raw = S.number(F.col("p_wide_raw")) if "p_wide_raw" in df.columns else F.lit(None).cast("double")
    source = "p_wide" if "p_wide" in df.columns else "p_wide_raw"
    return df.withColumns(
        {
            "p_wide_raw": raw,
            "p_wide": S.number(F.col(source)),
            "kumiban": S.pair_key(one, two),
            "horse_no_1": F.least(one, two),
            "horse_no_2": F.greatest(one, two),
        }
    )


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, coverage, missing_rate) from one pass over the data."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for c in columns])
    table = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("known")) for c in columns]
    )
    out = counts.select("rows", F.inline(table))
    rate = F.col("known") / F.col("rows")
    return out.select("column", "rows", rate.alias("coverage"), (1.0 - rate).alias("missing_rate"))


def output_summary(df: DataFrame) -> DataFrame:
    """Rows, races and date range of a dataset."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("race_id").alias("races"),
        F.min("race_date").alias("first_date"),
        F.max("race_date").alias("last_date"),
    )
