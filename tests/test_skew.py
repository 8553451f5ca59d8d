"""Splitting of hot keys gives what a plain window gives."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turfspark.operators import skew

# half of the rows hold one key
ROWS = [(0 if i % 2 else i % 7, (i * 37) % 101, i, (i * 13) % 50) for i in range(1200)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "k bigint, t bigint, id bigint, v bigint").persist()


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("limit", [10**9, 50])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(frame, limit, descending):
    got = skew.running_sums(frame, ["k"], "t", descending=descending, limit=limit, v=F.sum("v"))
    order = F.col("t").desc() if descending else F.col("t")
    before = W.partitionBy("k").orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    want = frame.select("k", "t", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("v")).distinct()
    assert same(got, want)


@pytest.mark.parametrize("limit", [10**9, 50])
def test_row_numbers_and_lags(frame, limit):
    order = W.partitionBy("k").orderBy("t", "id")
    got = skew.number_rows(frame, ["k"], [F.col("t"), F.col("id")], F.col("t"), "rn", limit=limit)
    want = frame.withColumn("rn", F.row_number().over(order).cast("bigint"))
    assert same(got.select(want.columns), want)
    lagged = skew.lagged(frame, "k", ["t", "id"], F.col("t"), ["id"], 3, limit=limit)
    got = lagged.select("id", *[F.col(f"_lag{i}.id").alias(f"l{i}") for i in (1, 2, 3)])
    want = frame.select("id", *[F.lag("id", i).over(order).alias(f"l{i}") for i in (1, 2, 3)])
    assert same(got, want)


@pytest.mark.parametrize("limit", [10**9, 50])
def test_ranks_and_percentiles(frame, limit):
    got = skew.average_rank(frame, ["k"], "v", limit=limit)
    w = W.partitionBy("k").orderBy("v")
    ties = F.count("v").over(W.partitionBy("k", "v"))
    want = frame.select(
        "k", "v", (F.rank().over(w) + (ties - 1) / 2.0).alias("_rank"), F.count("v").over(W.partitionBy("k")).alias("_count")
    ).distinct()
    assert same(got, want)
    for fraction in (0.0, 0.31, 0.5, 1.0):
        got = skew.exact_percentile(frame, [], "v", fraction, "p", limit=limit).first()["p"]
        assert got == pytest.approx(frame.agg(F.percentile("v", fraction)).first()[0])


def test_rolling_sums_half_open_range(spark):
    rows = [("a", 0, 1), ("a", 730, 10), ("a", 730, 10), ("a", 731, 100), ("b", 5, 7)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    got = {(r.k, r.t): r.s for r in skew.rolling_sums(df, ["k"], "t", 730, s=F.sum("v")).collect()}
    # the far end counts, the row's own time does not
    assert got == {("a", 0): 0, ("a", 730): 1, ("a", 731): 20, ("b", 5): 0}


def test_group_values_reach_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 5)], "k int, v int")
    got = skew.attach_group(df, ["k"], s=F.sum("v")).collect()
    assert sorted(r.s for r in got) == [3, 3, 5]


@pytest.mark.parametrize("limit", [10**9, 50])
@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers_with_null_keys_and_values(spark, limit, descending):
    rows = [(None if i % 2 else i % 3, None if i % 5 == 0 else (i * 37) % 101, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k bigint, p bigint, id bigint")
    p = F.col("p")
    order = [p.desc() if descending else p.asc(), F.col("id")]
    got = skew.number_rows(df, ["k"], order, -p if descending else p, "rn", limit=limit, nulls_last=descending)
    want = df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy(*order)).cast("bigint"))
    assert same(got.select(want.columns), want)


@pytest.mark.parametrize("limit", [10**9, 50])
def test_null_keys(spark, limit):
    """Many rows with a null key: no lags, sums and numbers of a key of their own, whatever the limit."""
    rows = [(None if i % 3 else i % 4, i % 59, i, i % 11) for i in range(600)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, id bigint, v bigint").persist()
    order = W.partitionBy("k").orderBy("t", "id")
    lagged = skew.lagged(df, "k", ["t", "id"], F.col("t"), ["id"], 2, limit=limit)
    got = lagged.select("id", *[F.col(f"_lag{i}.id").alias(f"l{i}") for i in (1, 2)])
    want = df.select("id", *[F.when(F.col("k").isNotNull(), F.lag("id", i).over(order)).alias(f"l{i}") for i in (1, 2)])
    assert same(got, want)
    got = skew.running_sums(df, ["k"], "t", limit=limit, v=F.sum("v"))
    before = W.partitionBy("k").orderBy("t").rangeBetween(W.unboundedPreceding, -1)
    assert same(got, df.select("k", "t", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("v")).distinct())
    got = skew.number_rows(df, ["k"], [F.col("t"), F.col("id")], F.col("t"), "rn", limit=limit)
    assert same(got.select("id", "rn"), df.select("id", F.row_number().over(order).cast("bigint").alias("rn")))


@pytest.mark.parametrize("limit", [10**9, 50])
@pytest.mark.parametrize("days", [1, 7])
def test_drawdown_of_a_day_with_all_bets(spark, limit, days):
    import datetime
    import random

    from turfspark.operators import wager

    rng, rows, deepest = random.Random(days), [], {}
    for strategy in ("a", "b"):
        level = peak = fall = 0
        for race in range(400):
            day = datetime.date(2024, 1, 1) + datetime.timedelta(days=race * days // 400)
            profits = [rng.randrange(-300, 310) for _ in range(rng.randrange(1, 3))]
            rows += [(strategy, day, race, p) for p in profits]
            level += sum(profits)
            peak = max(peak, level)
            fall = max(fall, peak - level)
        deepest[strategy] = fall
    bets = spark.createDataFrame(rows, f"{wager.STRATEGY} string, race_date date, race_id long, profit long")
    assert dict(wager.max_drawdown(bets.repartition(5), limit=limit).collect()) == deepest


def test_rolling_sums_shuffle_rows_once_and_ticks_once(spark):
    rows = [(1, 5, 2), (1, 5, None), (1, None, 4), (1, 15, 1), (2, 5, None), (1, 16, 8), (1, 10, 3)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = skew.rolling_sums(df, ["k"], "t", 10, s=F.sum("v"), n=F.count("*"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    want = {(1, None, 0, 0), (1, 5, 0, 0), (1, 10, 2, 2), (1, 15, 5, 3), (1, 16, 4, 2), (2, 5, None, 0)}
    assert {tuple(r) for r in got.collect()} == want
