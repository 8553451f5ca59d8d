"""Ordered and grouped work by key that stays parallel when one key holds most rows.

A plain window sends every row of a key to one task. The functions here first
count rows per key (a narrow aggregate with map-side combine). If no key is
above `turfspark.hotKeyRows`, the plan is the ordinary one-shuffle window. If
some are, those keys are split into ordered buckets, the ordered work is done
inside each bucket, and a small summary per bucket (a total, a count, the last
few rows) is carried from one bucket to the next.

The list of hot keys holds at most (rows / limit) rows, whatever the data, and
is the only thing broadcast here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfspark.session import hot_key_rows

BUCKETS = 256
BUCKET = "_bucket"
ALL = "_all"


def attach_group(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Add per-group aggregates to every row.

    Aggregation combines map-side and the join may be split by AQE, so one huge
    group costs one extra row per task instead of one overloaded task. Rows with
    a null key form a group of their own.
    """
    stats = df.groupBy(*[F.col(key).alias(f"_k_{key}") for key in keys]).agg(
        *[value.alias(name) for name, value in aggregates.items()]
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return df.join(stats, condition, "left").drop(*[f"_k_{key}" for key in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Keys with more rows than one task should sort, or None when there are none."""
    limit = limit or hot_key_rows(df.sparkSession)
    names = [F.col(key).alias(f"_h_{key}") for key in keys]
    sizes = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > limit).drop("_n")
    found = hot.agg(F.count(F.lit(1))).first()[0]
    return hot if found else None


def _join_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the keys come from the left."""
    renamed = right.withColumnsRenamed({key: f"_j_{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_j_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_j_{key}" for key in keys])


def with_buckets(
    df: DataFrame, keys: Sequence[str], order: Column, *, limit: int | None = None, nulls_last: bool = False
) -> tuple[DataFrame, bool]:
    """Add `_bucket` and `_hot` when some key is hot; otherwise return the frame as it is.

    Buckets are 0 for ordinary keys and 0..255, in the order of `order`, for hot
    ones. `order` is a number that grows with the wanted order; equal values
    share a bucket. Null values of it get a bucket of their own, before all
    others or after them. Null keys are keys like any other.
    """
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return df, False
    names = [f"_h_{key}" for key in keys]
    ordered = df.withColumn("_order", order.cast("double"))
    slim = ordered.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "_order")
    steps = F.array(*[F.lit(step / BUCKETS) for step in range(1, BUCKETS)])
    cuts = (
        _join_safe(slim, F.broadcast(hot), names)
        .groupBy(*names)
        .agg(F.coalesce(F.percentile_approx("_order", steps, 10_000), F.array().cast("array<double>")).alias("_cuts"))
    )
    condition = F.lit(True)
    for key, name in zip(keys, names, strict=True):
        condition = condition & F.col(key).eqNullSafe(F.col(name))
    below = F.when(F.col("_order").isNull(), BUCKETS if nulls_last else -1).otherwise(
        F.size(F.filter("_cuts", lambda cut: cut < F.col("_order")))
    )
    marked = (
        ordered.join(F.broadcast(cuts), condition, "left")
        .withColumn("_hot", F.col("_cuts").isNotNull())
        .withColumn(BUCKET, F.when(F.col("_hot"), below).otherwise(0))
        .drop("_cuts", "_order", *names)
    )
    return marked, True


def _with_global_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(ALL, F.lit(0)), [ALL])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    descending: bool = False,
    inclusive: bool = False,
    limit: int | None = None,
    **sums: Column,
) -> DataFrame:
    """(keys, order, sums): each sum over the rows of the key placed before `order`.

    Rows are first combined to one per (key, order value), so ties never count
    for one another. With `inclusive` the row's own value is added. `order` is
    a numeric column. Null keys are keys like any other.
    """
    base, keys_ = _with_global_key(df, keys)
    # repeated values collapse before the ordered shuffle
    distinct = base.groupBy(*keys_, order).agg(*[v.alias(n) for n, v in sums.items()])
    parts, split = with_buckets(distinct, keys_, F.col(order), limit=limit)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    end = Window.currentRow if inclusive else -1
    group = [*keys_, BUCKET] if split else keys_
    inside = (
        Window.partitionBy(*group)
        .orderBy(direction)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    within = {n: F.coalesce(F.sum(n).over(inside), F.col(n) * 0) for n in sums}
    if not split:
        return parts.select(*keys, order, *[column.alias(n) for n, column in within.items()])

    local = parts.withColumns({f"_p_{n}": column for n, column in within.items()})
    # totals of earlier buckets, at most 256 rows per hot key
    bucket_order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    before = (
        Window.partitionBy(*keys_).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        parts.filter("_hot")
        .groupBy(*group)
        .agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
        .select(*group, *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums])
    )
    return _join_safe(local, carry, group, "left").select(
        *keys,
        order,
        *[(F.col(f"_p_{n}") + F.coalesce(f"_c_{n}", F.col(n) * 0)).alias(n) for n in sums],
    )


def attach_running_sums(
    df: DataFrame, keys: Sequence[str], order: str, *, limit: int | None = None, **columns: str
) -> DataFrame:
    """Add to every row sums of columns over the rows of its key placed before `order`; none gives 0.

    Rows with the same `order` don't count for one another. `order` is a whole number. One shuffle, without a hot
    key; with one, the running sums are joined to the rows.
    """
    if hot_keys(df, keys, limit) is not None:
        sums = running_sums(df, keys, order, limit=limit, **{n: F.sum(c) for n, c in columns.items()})
        return _join_safe(df, sums, [*keys, order])
    earlier = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumns({n: F.coalesce(F.sum(c).over(earlier), F.col(c) * 0) for n, c in columns.items()})


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    order: Column,
    name: str,
    *,
    limit: int | None = None,
    nulls_last: bool = False,
) -> DataFrame:
    """Row number 1, 2, … within the keys in the order of `order_by`.

    `order` is a number that never falls along `order_by`; it decides how a hot
    key is cut into buckets. Say with `nulls_last` where `order_by` puts the rows
    whose `order` is null: first for an ascending column, last for a descending one.
    """
    parts, split = with_buckets(df, keys, order, limit=limit, nulls_last=nulls_last)
    if not split:
        alone = Window.partitionBy(*keys).orderBy(*order_by)
        return parts.withColumn(name, F.row_number().over(alone).cast("bigint"))
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order_by)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        parts.filter("_hot")
        .groupBy(*keys, BUCKET)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, BUCKET, F.sum("_n").over(before).alias("_before"))
    )
    numbered = parts.withColumn("_rn", F.row_number().over(inside).cast("bigint"))
    return (
        _join_safe(numbered, carry, [*keys, BUCKET], "left")
        .withColumn(name, F.col("_rn") + F.coalesce("_before", F.lit(0)))
        .drop("_rn", "_before", "_hot", BUCKET)
    )


def lagged(
    df: DataFrame,
    key: str,
    order_by: Sequence[str],
    order: Column,
    values: Sequence[str],
    depth: int,
    *,
    limit: int | None = None,
) -> DataFrame:
    """Add struct columns `_lag1`..`_lagN` with `values` of the N rows before in the key.

    Inside a bucket this is `lag`; the first rows of a later bucket of a hot key
    take the last `depth` rows of the buckets before it. A row with a null key has
    no rows before it, however many such rows there are.
    """
    payload = F.struct(*values)
    known = df.filter(F.col(key).isNotNull())
    none = {f"_lag{k}": F.when(F.lit(False), payload) for k in range(1, depth + 1)}
    alone = df.filter(F.col(key).isNull()).withColumns(none)
    return _lagged_known(known, key, order_by, order, payload, depth, limit).unionByName(alone)


def _lagged_known(
    df: DataFrame, key: str, order_by: Sequence[str], order: Column, payload: Column, depth: int, limit: int | None
) -> DataFrame:
    parts, split = with_buckets(df, [key], order, limit=limit)
    if not split:
        alone = Window.partitionBy(key).orderBy(*order_by)
        return parts.withColumns(
            {f"_lag{k}": F.lag(payload, k).over(alone) for k in range(1, depth + 1)}
        )
    forward = Window.partitionBy(key, BUCKET).orderBy(*order_by)
    backward = Window.partitionBy(key, BUCKET).orderBy(*[F.col(c).desc() for c in order_by])
    rows = parts.withColumn("_pos", F.row_number().over(forward)).withColumns(
        {f"_l{k}": F.lag(payload, k).over(forward) for k in range(1, depth + 1)}
    )
    # the last `depth` rows of each bucket of a hot key, nearest first
    tails = (
        parts.filter("_hot")
        .withColumn("_back", F.row_number().over(backward))
        .filter(F.col("_back") <= depth)
        .groupBy(key, BUCKET)
        .agg(F.sort_array(F.collect_list(F.struct("_back", payload.alias("v")))).alias("_tail"))
    )
    along = Window.partitionBy(key).orderBy(BUCKET)
    empty = F.filter("_tail", lambda _: F.lit(False))
    earlier = [F.coalesce(F.lag("_tail", k).over(along), empty) for k in range(1, depth + 1)]
    carry = tails.select(key, BUCKET, F.slice(F.concat(*earlier), 1, depth).alias("_carry"))
    joined = rows.join(carry, [key, BUCKET], "left")
    from_carry = lambda k: F.try_element_at("_carry", F.lit(k) - F.col("_pos") + 1)["v"]
    return joined.withColumns(
        {
            f"_lag{k}": F.when(F.col("_pos") > k, F.col(f"_l{k}")).otherwise(from_carry(k))
            for k in range(1, depth + 1)
        }
    ).drop("_pos", "_carry", "_hot", BUCKET, *[f"_l{k}" for k in range(1, depth + 1)])


def rolling_sums(
    df: DataFrame, keys: Sequence[str], time: str, width: int, **sums: Column
) -> DataFrame:
    """(keys, time, sums) over the half-open range [time - width, time) of each key.

    Every value enters at its time and leaves at time + width, so one running
    sum gives the rolling one: linear work, where a sliding frame would add up
    its whole window again for every row. Rows are first combined per
    (key, time), so a key holds at most one row per tick of the calendar,
    however many rows it has. Sums must be exact (integers or decimals): then
    what left the window leaves no rounding residue. Keys must not be null.
    """
    names = list(sums)
    entering = df.groupBy(*keys, time).agg(*[v.alias(n) for n, v in sums.items()])
    # a row that enters and one that leaves; a shuffle by the keys is all the frame needs, ties count for nothing
    change = lambda at, asked, value: F.struct(at.alias(time), F.lit(asked).alias("_asked"), *[value(n).alias(n) for n in names])
    enters = change(F.col(time), 1, F.col)
    leaves = change(F.col(time) + width, 0, lambda n: -F.col(n))
    marked = entering.select(*keys, F.inline(F.array(enters, leaves)))
    before = (
        Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    )
    return (
        marked.select(
            *keys,
            time,
            "_asked",
            *[F.coalesce(F.sum(n).over(before), F.col(n) * 0).alias(n) for n in names],
        )
        .filter("_asked = 1")
        .drop("_asked")
    )


def average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    descending: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """(keys, value, _rank, _count): rank with ties sharing the mean of their places.

    Only non-null values take part; `_count` is their number in the group.
    """
    present = df.filter(F.col(value).isNotNull()).select(*keys, value)
    placed = running_sums(
        present, keys, value, descending=descending, inclusive=True, limit=limit,
        _upto=F.count(F.lit(1)),
    )
    ties = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    totals = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    return (
        placed.join(ties, [*keys, value])
        .join(totals, list(keys))
        .select(
            *keys,
            value,
            (F.col("_upto") - (F.col("_ties") - 1) / 2.0).alias("_rank"),
            "_count",
        )
    )


def exact_percentile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fraction: float,
    name: str,
    *,
    limit: int | None = None,
) -> DataFrame:
    """(keys, name): percentile with linear interpolation, without holding a group in one task."""
    base, keys_ = _with_global_key(df.filter(F.col(value).isNotNull()), keys)
    totals = base.groupBy(*keys_).agg(F.count(F.lit(1)).alias("_total"))
    counts = base.groupBy(*keys_, value).agg(F.count(F.lit(1)).alias("_n"))
    # zero-based places `_first.._upto-1` are taken by each distinct value
    placed = running_sums(
        counts, keys_, value, inclusive=True, limit=limit, _upto=F.sum("_n")
    ).join(counts, [*keys_, value])
    position = (F.col("_total") - 1) * F.lit(float(fraction))
    low, high = F.floor(position), F.ceil(position)
    first = F.col("_upto") - F.col("_n")
    holds = lambda place: (place >= first) & (place < F.col("_upto"))
    return (
        placed.join(totals, keys_)
        .filter(holds(low) | holds(high))
        .groupBy(*keys_, "_total")
        .agg(
            F.max(F.when(holds(low), F.col(value))).alias("_low"),
            F.max(F.when(holds(high), F.col(value))).alias("_high"),
        )
        .select(
            *keys,
            (F.col("_low") + (F.col("_high") - F.col("_low")) * (position - low)).alias(name),
        )
    )
