"""Wager backtest: candidates, stakes, caps, settlement and reports.

Stakes refer to a fixed reference bankroll, so races are independent until the
daily cap; a strategy is a row of parameters and every step is keyed by it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfspark.functions import market as M
from turfspark.functions import scalars as S
from turfspark.operators import skew
from turfspark.session import stored

# fixed values: default wager rules
DEFAULTS = {
    "bankroll": 1_000_000,
    "kelly_scale": 0.25,
    "max_bets": 5,
    "race_cap": 0.05,
    "day_cap": 0.2,
    "unit": 100,
    "min_bet": 100,
    "max_bet": 0,
    "ev_threshold": 0.0,
    "min_p": 0.0,
    "min_p_stage": "candidate",
}
STRATEGY = "strategy_id"


def latest_pair_odds(odds: DataFrame) -> DataFrame:
    """Newest lower odds of each pair: last kind of announcement, then last time; odds above 1."""
    newest = F.struct("data_kbn", "announce_mmddhhmi")
    return (
        odds.filter("min_odds_x10 > 0")
        .groupBy("race_id", "kumiban")
        .agg(F.max_by("min_odds_x10", newest).alias("_x10"))
        .select("race_id", "kumiban", (F.col("_x10") / 10.0).alias("odds"))
        .filter("odds > 1")
    )


def with_strategies(df: DataFrame, strategies: Sequence[Mapping[str, object]]) -> DataFrame:
    """Each row once per strategy. Strategies are a short literal list; missing rules take defaults."""
    full = [{**DEFAULTS, STRATEGY: i, **s} for i, s in enumerate(strategies)]
    names = [STRATEGY, *DEFAULTS]
    table = F.array(*[F.struct(*[F.lit(s[n]).alias(n) for n in names]) for s in full])
    return df.select("*", F.inline(table))


def _rules(df: DataFrame) -> DataFrame:
    return df if STRATEGY in df.columns else with_strategies(df, [{}])


def candidates(
    pair: DataFrame, odds: DataFrame, strategies: Sequence[Mapping[str, object]] | None = None
) -> DataFrame:
    """Priced pairs that pass the probability floor and the expected-profit threshold.

    With `strategies` each pair is priced once and then repeated per strategy, so the join moves no copies.
    """
    if strategies is not None:
        priced = with_strategies(pair.join(odds, ["race_id", "kumiban"]), strategies)
    else:
        priced = _rules(pair).join(odds, ["race_id", "kumiban"])
    early = F.col("min_p_stage") == "candidate"
    floor = F.col("min_p") > 0
    return priced.withColumn("ev_profit", M.expected_profit(F.col("p_wide"), F.col("odds"))).filter(
        (~(early & floor) | (F.col("p_wide") >= F.col("min_p")))
        & (F.col("ev_profit") >= F.col("ev_threshold"))
    )


def race_stakes(rows: DataFrame, *, most: int | None = None) -> DataFrame:
    """Best candidates of each race with their stakes, scaled to the race cap.

    The ranking keeps `max_bets` rows per race and strategy. Give the largest
    `max_bets` in use as `most` and tasks drop the rest before the shuffle; a
    strategy that allows more than `most` is an error.
    """
    group = [STRATEGY, "race_id"]
    best = Window.partitionBy(*group).orderBy(
        F.col("ev_profit").desc(), F.col("p_wide").desc(), F.col("kumiban")
    )
    known = rows.dropna(subset=["p_wide", "odds", "ev_profit"])
    limit = F.col("max_bets")
    ranked = known.withColumn("_rn", F.row_number().over(best))
    if most:
        short = F.raise_error(F.lit(f"a strategy allows more than {most} bets per race"))
        ranked = ranked.filter(F.when((limit <= 0) | (limit > most), short.cast("boolean")).otherwise(F.col("_rn") <= most))
    top = ranked.filter((limit <= 0) | (F.col("_rn") <= limit))
    raw = F.col("kelly_f") * F.col("bankroll")
    capped = F.when(F.col("max_bet") > 0, F.least(raw, F.col("max_bet").cast("double"))).otherwise(raw)
    staked = (
        top.withColumn("kelly_f", M.fractional_kelly(F.col("p_wide"), F.col("odds"), F.col("kelly_scale")))
        .withColumn("bet", M.floor_to_unit(capped, F.col("unit")))
        .filter(F.col("bet") >= F.col("min_bet"))
    )
    cap = M.floor_to_unit(F.col("bankroll") * F.col("race_cap"), F.col("unit"))
    # the partition of the ranking: no other shuffle
    total = staked.withColumn("_total", F.sum("bet").over(Window.partitionBy(*group))).withColumn("_cap", cap)
    return scale_to(total.filter("_cap > 0"), "_total", "_cap").drop("_rn", "_total", "_cap")


def scale_to(df: DataFrame, total: str, cap: str) -> DataFrame:
    """Scale bets so that `total` fits `cap`, floor again, and drop what falls below the minimum."""
    scaled = M.floor_to_unit(F.col("bet") * (F.col(cap) / F.col(total)), F.col("unit"))
    over = F.col(total) > F.col(cap)
    return df.withColumn("bet", F.when(over, scaled).otherwise(F.col("bet"))).filter(
        ~over | (F.col("bet") >= F.col("min_bet"))
    )


def _passes() -> Column:
    """Whether a chosen bet meets the probability floor, where the strategy applies it to chosen bets."""
    late = (F.col("min_p_stage") == "selected") & (F.col("min_p") > 0)
    return ~late | (F.col("p_wide") >= F.col("min_p"))


def _placed(remaining: Column) -> Column:
    """What a race takes from the day when `remaining` is left, from its array of (bet, passes).

    The whole race is scaled, but only bets that pass the floor use up the day.
    """
    scale = remaining / F.col("_total")

    def add(acc: Column, b: Column) -> Column:
        bet = M.floor_to_unit(b["bet"] * scale, F.col("unit"))
        return acc + F.when(b["passes"] & (bet >= F.col("min_bet")), bet).otherwise(0)

    return (
        F.when(remaining <= 0, F.lit(0).cast("bigint"))
        .when(F.col("_total") <= remaining, F.col("_uses"))
        .otherwise(F.aggregate("_bets", F.lit(0).cast("bigint"), add))
    )


def daily_cap(bets: DataFrame) -> DataFrame:
    """Apply the daily cap in race order: a race gets at most what the day has left.

    A race uses up what its bets that pass the strategy's floor for chosen bets
    stake; the others are scaled with the race and dropped. Races before the cap
    is reached are untouched, and where that is follows from a running sum. The
    first race over the cap is scaled down. After it, each round finds the next
    race of every day that still takes something as a minimum, and no day is
    ever gathered in one place. Rounds end when no race takes anything: without
    a late floor what is left is less than a unit per bet, so there are few.

    A race is stored once as one row with its bets (99 runners at most, so 4,851 pairs); nothing else moves
    bets. A round reads the sums of these rows; its state is one stored row per strategy and day. Bets
    without a strategy, date or race are left out.
    """
    day = [STRATEGY, "race_date"]
    race = [*day, "race_id"]
    rules = ["bankroll", "day_cap", "unit", "min_bet"]
    floored = "min_p_stage" in bets.columns
    passes = F.coalesce(_passes(), F.lit(False)) if floored else F.lit(True)
    others = [c for c in bets.columns if c not in (*race, *rules)]
    cap = M.floor_to_unit(F.col("bankroll") * F.col("day_cap"), F.col("unit"))
    races = stored(
        bets.dropna(subset=race)
        .groupBy(*race, *rules)
        .agg(
            F.sum("bet").alias("_total"),
            F.coalesce(F.sum(F.when(passes, F.col("bet"))), F.lit(0)).cast("bigint").alias("_uses"),
            F.collect_list(F.struct("bet", passes.alias("passes"))).alias("_bets"),
            F.collect_list(F.struct(*others)).alias("_rows"),
        )
        .withColumn("_cap", cap)
    )
    slim = races.select(*race, "_total", "_uses", "_cap")
    placed = skew.attach_running_sums(slim, day, "race_id", _before="_uses")
    fits = F.col("_before") + F.col("_total") <= F.col("_cap")
    # first race of the day that does not fit as it is
    first = stored(
        placed.filter(~fits)
        .groupBy(*day)
        .agg(F.min_by(F.struct("race_id", "_before", "_cap"), F.col("race_id")).alias("_f"))
        .select(*day, F.col("_f.race_id").alias("_from"), (F.col("_f._cap") - F.col("_f._before")).alias("_left"))
    )
    state = first.select(*day, (F.col("_from") - 1).alias("_at"), "_left")
    rounds = []
    while True:
        open_races = races.drop("_rows").join(state, day).filter(F.col("race_id") > F.col("_at"))
        taking = open_races.withColumn("_take", _placed(F.col("_left"))).filter("_take > 0")
        nearest = stored(
            taking.groupBy(*day)
            .agg(F.min_by(F.struct("race_id", "_take", "_left"), F.col("race_id")).alias("_n"))
            .select(*day, "_n.*")
        )
        if nearest.isEmpty():
            break
        rounds.append(nearest.select(*race, F.col("_left").alias("_room")))
        state = nearest.select(
            *day, F.col("race_id").alias("_at"), (F.col("_left") - F.col("_take")).alias("_left")
        )
    whole = races.join(first.select(*day, "_from"), day, "left")
    early = F.col("_from").isNull() | (F.col("race_id") < F.col("_from"))
    kept = whole.filter(early).withColumn("_room", F.col("_total"))
    if rounds:
        late = whole.filter(~early).join(reduce(DataFrame.unionByName, rounds), race)
        kept = kept.unionByName(late)
    fitted = kept.select(*race, *rules, "_total", "_room", F.inline("_rows"))
    scaled = scale_to(fitted, "_total", "_room").drop("_total", "_room").select(*race, *[c for c in bets.columns if c not in race])
    return selected_floor(scaled) if floored else scaled


def selected_floor(bets: DataFrame) -> DataFrame:
    """Probability floor applied to the bets that were chosen."""
    return bets.filter(_passes())


def settle(bets: DataFrame, payouts: DataFrame) -> DataFrame:
    """Payout per 100 staked, return and profit; no payout row means a miss."""
    joined = bets.join(
        payouts.select("race_id", "kumiban", "payout_yen"), ["race_id", "kumiban"], "left"
    )
    per_100 = F.coalesce(F.col("payout_yen").cast("bigint"), F.lit(0).cast("bigint"))
    paid = F.when(per_100 > 0, F.floor(F.col("bet") / 100) * per_100).otherwise(0)
    return (
        joined.withColumn("payout_yen_per_100", per_100)
        .withColumn("is_hit", per_100 > 0)
        .withColumn("payout", paid)
        .withColumn("profit", F.col("payout") - F.col("bet"))
        .drop("payout_yen")
    )


def runner_names(df: DataFrame, runners: DataFrame) -> DataFrame:
    """Names of both members; a runner without a name is shown by its number."""
    names = runners.select("race_id", "horse_no", F.trim("horse_name").alias("_name"))
    out = df
    for side in (1, 2):
        column = f"horse_no_{side}"
        named = names.withColumnsRenamed({"horse_no": column, "_name": f"_name_{side}"})
        shown = F.when(F.col(f"_name_{side}") != "", F.col(f"_name_{side}"))
        # fixed value: label of a runner without a name
        label = F.concat(F.lit("馬番"), F.col(column).cast("string"))
        out = (
            out.join(named, ["race_id", column], "left")
            .withColumn(f"horse_name_{side}", F.coalesce(shown, label))
            .drop(f"_name_{side}")
        )
    return out


def ledger(settled: DataFrame) -> DataFrame:
    """Report rows: one per bet, rounded."""
    extra = [c for c in ("p_top3_1", "p_top3_2") if c in settled.columns]
    names = [c for c in ("horse_name_1", "horse_name_2") if c in settled.columns]
    shown = (
        [F.concat_ws(" / ", "horse_name_1", "horse_name_2").alias("horse_name")] if names else []
    )
    return settled.select(
        STRATEGY,
        F.date_format("race_date", "yyyy-MM-dd").alias("race_date"),
        "race_id",
        *shown,
        "horse_no_1",
        "horse_no_2",
        *names,
        "kumiban",
        S.round_report(F.col("p_wide"), 6).alias("p_wide"),
        *[S.round_report(F.col(c), 6).alias(c) for c in extra],
        S.round_report(F.col("odds"), 1).alias("odds_final"),
        S.round_report(F.col("ev_profit"), 6).alias("ev_profit"),
        S.round_report(F.col("kelly_f"), 8).alias("kelly_f"),
        F.col("bet").alias("bet_yen"),
        "payout_yen_per_100",
        "is_hit",
        "payout",
        "profit",
    )


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_bets"),
        F.count(F.when(F.col("is_hit"), 1)).alias("n_hits"),
        F.sum("bet").alias("total_bet"),
        F.sum("payout").alias("total_return"),
    ]


def monthly(settled: DataFrame) -> DataFrame:
    roi = F.when(F.col("total_bet") > 0, F.col("total_return") / F.col("total_bet")).otherwise(0.0)
    month = F.date_format("race_date", "yyyy-MM").alias("month")
    return settled.groupBy(STRATEGY, month).agg(*_totals()).withColumn("roi", F.bround(roi, 4))


def max_drawdown(settled: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Deepest fall of the equity curve from its peak, per strategy, in race order.

    A stretch of races is summed up by its sum, its highest and lowest point and its own deepest fall; summaries of
    stretches that follow one another give that of both. A stretch is a day, or a bucket of a day with more races
    than one task should put in order. The curve starts at zero before the first race.
    """
    day = [STRATEGY, "race_date"]
    races = settled.groupBy(*day, "race_id").agg(F.sum("profit").alias("_p"))
    parts, split = skew.with_buckets(races, day, F.col("race_id"), limit=limit)
    stretch = [*day, skew.BUCKET] if split else day
    inside = Window.partitionBy(*stretch).orderBy("race_id").rowsBetween(Window.unboundedPreceding, 0)
    curve = parts.withColumn("_e", F.sum("_p").over(inside))
    fall = F.greatest(F.max("_e").over(inside), F.lit(0)) - F.col("_e")
    stretches = curve.withColumn("_fall", fall).groupBy(*stretch).agg(
        F.max("_e").alias("_high"), F.min("_e").alias("_low"), F.max("_fall").alias("_fall"), F.sum("_p").alias("_sum")
    )
    # one row per day or bucket is left to put in order
    order = Window.partitionBy(STRATEGY).orderBy(*stretch[1:])
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = stretches.withColumn("_open", F.coalesce(F.sum("_sum").over(past), F.lit(0)))
    peaked = opened.withColumn(
        "_peak", F.greatest(F.coalesce(F.max(F.col("_open") + F.col("_high")).over(past), F.lit(0)), F.lit(0))
    )
    from_peak = F.col("_peak") - (F.col("_open") + F.col("_low"))
    return peaked.groupBy(STRATEGY).agg(
        F.max(F.greatest("_fall", from_peak, F.lit(0))).alias("max_drawdown")
    )


def summary(settled: DataFrame, considered: DataFrame | None = None) -> DataFrame:
    """One row per strategy: period, races, bets, hits, stakes, returns and drawdown.

    `considered` holds the races that were looked at; without it the races with
    bets are counted.
    """
    totals = settled.groupBy(STRATEGY).agg(
        F.date_format(F.min("race_date"), "yyyy-MM-dd").alias("period_from"),
        F.date_format(F.max("race_date"), "yyyy-MM-dd").alias("period_to"),
        F.count_distinct("race_id").alias("n_races"),
        *_totals(),
    )
    if considered is not None:
        races = considered.agg(F.count_distinct("race_id").alias("n_races"))
        totals = totals.withColumn("n_races", races.scalar())
    hit = F.when(F.col("n_bets") > 0, F.col("n_hits") / F.col("n_bets")).otherwise(0.0)
    roi = F.when(F.col("total_bet") > 0, F.col("total_return") / F.col("total_bet")).otherwise(0.0)
    return (
        totals.withColumn("hit_rate", F.bround(hit, 4))
        .withColumn("roi", F.bround(roi, 4))
        .join(max_drawdown(settled), STRATEGY)
    )
