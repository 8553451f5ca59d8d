"""Stakes and the daily cap move each bet once, however many races follow the cap."""

import random

import pytest
from pyspark.sql import functions as F

from turfspark.operators import skew, wager
from turfspark.session import HOT_KEY_ROWS_CONF

RULES = "strategy_id int, race_date string, bankroll long, day_cap double, unit int, min_bet int, min_p_stage string, min_p double"


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def _bets(spark, days=4, races=30):
    draw = random.Random(7)
    rows = []
    for day in range(days):
        for race in range(races):
            for k in range(draw.randint(1, 4)):
                bet, p = 100 * draw.randint(1, 60), draw.random()
                rows.append((0, f"2024-01-0{day + 1}", 1_000_000, 0.02, 100, 100, "selected", 0.3, 1000 * day + race, f"{k}", bet, p))
    return rows, spark.createDataFrame(rows, RULES + ", race_id long, kumiban string, bet long, p_wide double")


def _replayed(rows):
    want = []
    for day in {r[1] for r in rows}:
        left = 20_000
        for race in sorted({r[8] for r in rows if r[1] == day}):
            bets = [(r[9], r[10], r[11]) for r in rows if r[8] == race]
            total = sum(b for _, b, _ in bets)
            if left <= 0:
                break
            if total > left:
                bets = [(k, int(b * (left / total) // 100) * 100, p) for k, b, p in bets]
            placed = [(race, k, b) for k, b, p in bets if b >= 100 and p >= 0.3]
            left -= sum(b for _, _, b in placed)
            want += placed
    return sorted(want)


@pytest.mark.parametrize("limit", [10**9, 12])
def test_daily_cap_equals_a_replay_and_moves_no_bets(spark, limit):
    rows, bets = _bets(spark)
    spark.conf.set(HOT_KEY_ROWS_CONF, str(limit))
    try:
        got = wager.daily_cap(bets)
    finally:
        spark.conf.unset(HOT_KEY_ROWS_CONF)
    assert sorted((r.race_id, r.kumiban, r.bet) for r in got.collect()) == _replayed(rows)
    assert _shuffles(got) == 0  # rooms of races are joined to the stored races; bets stay where they are
    assert sorted(got.columns) == sorted(bets.columns)


def test_stakes_take_one_shuffle(spark):
    priced = spark.createDataFrame([(1, "a", 0.5, 3.0), (1, "b", 0.4, 4.0), (2, "a", 0.2, 6.0)], "race_id long, kumiban string, p_wide double, odds double")
    rows = wager.with_strategies(priced, [{}, {"race_cap": 0.01}]).withColumn("ev_profit", F.col("p_wide") * F.col("odds") - 1)
    staked = wager.race_stakes(rows, most=5)
    assert _shuffles(staked) == 1
    assert sorted((r.strategy_id, r.race_id, r.kumiban, r.bet) for r in staked.collect()) == [
        (0, 1, "a", 27_700), (0, 1, "b", 22_200), (0, 2, "a", 10_000), (1, 1, "a", 5_500), (1, 1, "b", 4_400), (1, 2, "a", 10_000),
    ]


def test_pairs_are_priced_before_they_are_repeated(spark):
    pair = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.2), (2, "a", 0.9)], "race_id long, kumiban string, p_wide double")
    odds = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (1, "c", 9.0)], "race_id long, kumiban string, odds double")
    rules = [{}, {"min_p": 0.6}, {"ev_threshold": 0.6}]
    got = wager.candidates(pair, odds, rules)
    assert sorted((r.strategy_id, r.race_id, r.kumiban) for r in got.collect()) == [(0, 1, "a")]
    want = wager.candidates(wager.with_strategies(pair, rules), odds)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(got.columns)).collect()))


@pytest.mark.parametrize("limit", [10**9, 3])
def test_running_sums_beside_their_rows(spark, limit):
    rows = [("a", 1, 5), ("a", 1, 6), ("a", 2, 7), ("a", 4, 1), ("b", 3, 2)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = skew.attach_running_sums(df, ["k"], "t", limit=limit, s="v")
    assert sorted((r.k, r.t, r.v, r.s) for r in got.collect()) == [("a", 1, 5, 0), ("a", 1, 6, 0), ("a", 2, 7, 11), ("a", 4, 1, 18), ("b", 3, 2, 0)]
