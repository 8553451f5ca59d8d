"""Pairs, odds, stakes, settlement and reports over pairs of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark.catalog.base import Tables, cte, query
from turfspark.functions import market as M
from turfspark.operators import joins, wager
from turfspark.plans import backtest

# the defaults, few small bets with a tight daily cap, and a floor on the bets that were chosen
STRATEGIES = (
    {"ev_threshold": 0.05},
    {"ev_threshold": 0.0, "max_bets": 2, "kelly_scale": 0.5, "day_cap": 0.02, "race_cap": 0.01,
     "min_p": 0.1, "max_bet": 9000, "min_bet": 300},
    {"ev_threshold": 0.02, "max_bets": 4, "day_cap": 0.03, "min_p": 0.06, "min_p_stage": "selected"},
)
MOST_BETS = max(int(s.get("max_bets", wager.DEFAULTS["max_bets"])) for s in STRATEGIES)

cte(
    "wide_log",
    """
    SELECT race_id, kumiban, v % 4 + 1 AS data_kbn, lpad(CAST((v * 37 + part_1) % 1000 AS VARCHAR), 8, '0') AS announce,
           CASE WHEN (part_1 + v) % 17 > 0 THEN 9 + (part_1 * v + part_2) % 400 END AS x10
    FROM pair, range(1, 4) r(v)
    """,
    "pair",
)
cte(
    "wide_odds",
    """
    SELECT race_id, kumiban, x10 / 10.0 AS odds FROM (
        SELECT race_id, kumiban, max_by(x10, data_kbn * 100000000 + CAST(announce AS BIGINT)) AS x10
        FROM wide_log WHERE x10 > 0 GROUP BY race_id, kumiban) WHERE x10 > 10
    """,
    "wide_log",
)
cte(
    "wide_payout",
    """
    SELECT race_id, kumiban, 100 + 10 * ((part_1 + part_2) % 50) AS payout_yen FROM pair WHERE y_wide = 1
    """,
    "pair",
)
cte(
    "strategy",
    """
    SELECT * FROM (VALUES (0, 0.25e0, 5, 50000, 200000, 0, 100, 0.05e0, 0e0, 0e0),
                          (1, 0.5e0, 2, 10000, 20000, 9000, 300, 0e0, 0.1e0, 0e0),
                          (2, 0.25e0, 4, 50000, 30000, 0, 100, 0.02e0, 0e0, 0.06e0))
        s(strategy_id, scale, max_bets, race_cap, day_cap, max_bet, min_bet, threshold, min_p, late_p)
    """,
)
cte(
    "candidate",
    """
    SELECT p.race_id, race_date, p.kumiban, horse_no_1, horse_no_2, p_wide, odds, p_wide * odds - 1.0 AS ev_profit,
           greatest((p_wide * odds - 1.0) / (odds - 1.0), 0) * scale AS kelly_f, s.*
    FROM pair p JOIN wide_odds o USING (race_id, kumiban) JOIN race r ON r.race_id = p.race_id, strategy s
    WHERE (min_p = 0 OR p_wide >= min_p) AND p_wide * odds - 1.0 >= threshold
    """,
    "pair", "wide_odds", "race", "strategy",
)
cte(
    "staked",
    """
    SELECT *, sum(bet) OVER (PARTITION BY strategy_id, race_id) AS total FROM (
        SELECT *, CAST(floor(CASE WHEN max_bet > 0 THEN least(kelly_f * 1000000, max_bet) ELSE kelly_f * 1000000 END / 100) * 100 AS BIGINT) AS bet
        FROM candidate
        QUALIFY row_number() OVER (PARTITION BY strategy_id, race_id ORDER BY ev_profit DESC, p_wide DESC, kumiban) <= max_bets)
    WHERE bet >= min_bet
    """,
    "candidate",
)
cte(
    "raced",
    """
    SELECT * REPLACE (CASE WHEN total > race_cap
                           THEN CAST(floor(bet * (race_cap::DOUBLE / total) / 100) * 100 AS BIGINT) ELSE bet END AS bet)
    FROM staked
    WHERE total <= race_cap OR floor(bet * (race_cap::DOUBLE / total) / 100) * 100 >= min_bet
    """,
    "staked",
)
# replay the races of each day one after another
cte(
    "capped",
    """
    WITH RECURSIVE day_race AS (
        SELECT strategy_id, race_date, race_id, day_cap, min_bet, list(bet) FILTER (p_wide >= late_p) AS bets,
               sum(bet) AS total, coalesce(sum(bet) FILTER (p_wide >= late_p), 0) AS uses,
               row_number() OVER (PARTITION BY strategy_id, race_date ORDER BY race_id) AS n
        FROM raced GROUP BY strategy_id, race_date, race_id, day_cap, min_bet),
    spent AS (
        SELECT strategy_id, race_date, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS race_id, CAST(0 AS BIGINT) AS used,
               CAST(0 AS BIGINT) AS room
        FROM day_race WHERE n = 1
        UNION ALL
        SELECT d.strategy_id, d.race_date, d.n, d.race_id,
               CAST(s.used + CASE WHEN d.day_cap - s.used <= 0 THEN 0 WHEN d.total <= d.day_cap - s.used THEN d.uses
                    ELSE coalesce(list_sum(list_filter(list_transform(d.bets,
                         lambda b: floor(b * ((d.day_cap - s.used)::DOUBLE / d.total) / 100) * 100),
                         lambda x: x >= d.min_bet)), 0) END AS BIGINT),
               CAST(d.day_cap - s.used AS BIGINT)
        FROM spent s JOIN day_race d
          ON d.strategy_id = s.strategy_id AND d.race_date = s.race_date AND d.n = s.n + 1)
    SELECT r.* REPLACE (CASE WHEN d.total > s.room THEN CAST(floor(r.bet * (s.room::DOUBLE / d.total) / 100) * 100 AS BIGINT)
                             ELSE r.bet END AS bet)
    FROM raced r JOIN spent s USING (strategy_id, race_id) JOIN day_race d USING (strategy_id, race_id)
    WHERE s.room > 0 AND r.p_wide >= r.late_p AND (d.total <= s.room OR floor(r.bet * (s.room::DOUBLE / d.total) / 100) * 100 >= r.min_bet)
    """,
    "raced",
)
cte(
    "settled",
    """
    SELECT c.*, coalesce(payout_yen, 0) AS per_100, payout_yen IS NOT NULL AS is_hit,
           CAST(c.bet // 100 * coalesce(payout_yen, 0) AS BIGINT) AS payout,
           CAST(c.bet // 100 * coalesce(payout_yen, 0) - c.bet AS BIGINT) AS profit
    FROM capped c LEFT JOIN wide_payout USING (race_id, kumiban)
    """,
    "capped", "wide_payout",
)


def wide_log(t: Tables) -> DataFrame:
    v = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("v")
    rows = t.pair.select("race_id", "kumiban", "part_1", "part_2", v)
    return rows.select(
        "race_id",
        "kumiban",
        (F.col("v") % 4 + 1).alias("data_kbn"),
        F.lpad(((F.col("v") * 37 + F.col("part_1")) % 1000).cast("string"), 8, "0").alias("announce_mmddhhmi"),
        F.when(
            (F.col("part_1") + F.col("v")) % 17 > 0, 9 + (F.col("part_1") * F.col("v") + F.col("part_2")) % 400
        ).alias("min_odds_x10"),
    )


def wide_payout(t: Tables) -> DataFrame:
    paid = (100 + 10 * ((F.col("part_1") + F.col("part_2")) % 50)).alias("payout_yen")
    return t.pair.filter("y_wide = 1").select("race_id", F.lit(5).alias("bet_type"), F.col("kumiban").alias("selection"), paid)


def dated_pairs(t: Tables) -> DataFrame:
    slim = t.pair.select("race_id", "horse_no_1", "horse_no_2", "kumiban", "p_wide")
    return slim.join(t.race.select("race_id", "race_date"), "race_id")


def candidates(t: Tables) -> DataFrame:
    return wager.candidates(dated_pairs(t), wager.latest_pair_odds(wide_log(t)), STRATEGIES)


def settled(t: Tables) -> DataFrame:
    return backtest.settled_bets(dated_pairs(t), wide_log(t), wide_payout(t), STRATEGIES)


@query(
    "pairs",
    "SELECT race_id, horse_no_1, horse_no_2, kumiban, part_1, part_2 FROM pair",
    ["pair"],
)
def pairs(t: Tables) -> DataFrame:
    return t.pair.select("race_id", "horse_no_1", "horse_no_2", "kumiban", "part_1", "part_2")


@query("pair_labels", "SELECT race_id, kumiban, y_wide FROM pair", ["pair"])
def pair_labels(t: Tables) -> DataFrame:
    first_three = joins.top3(t.runner)
    return joins.label_pairs(t.pair.drop("y_wide"), first_three).select("race_id", "kumiban", "y_wide")


@query(
    "race_values_on_pairs",
    """
    SELECT p.race_id, kumiban, r.race_date, r.track_code FROM pair p JOIN race r ON p.race_id = r.race_id
    """,
    ["pair", "race"],
)
def race_values_on_pairs(t: Tables) -> DataFrame:
    pair = t.pair.select("race_id", "kumiban")
    return joins.carry_race_values(pair, t.race, ["race_date", "track_code"])


@query("latest_pair_odds", "SELECT race_id, kumiban, CAST(odds AS DOUBLE) AS odds FROM wide_odds", ["wide_odds"])
def latest_pair_odds(t: Tables) -> DataFrame:
    return wager.latest_pair_odds(wide_log(t))


# a multiple of pi is never halfway between two rounded values
@query(
    "candidates_ev",
    """
    SELECT strategy_id, race_id, kumiban, round(ev_profit, 8) AS ev_profit, round(kelly_f * pi(), 9) AS kelly_pi FROM candidate
    """,
    ["candidate"],
)
def candidates_ev(t: Tables) -> DataFrame:
    kelly = M.fractional_kelly(F.col("p_wide"), F.col("odds"), F.col("kelly_scale"))
    return candidates(t).select(
        "strategy_id", "race_id", "kumiban", F.round("ev_profit", 8).alias("ev_profit"), F.round(kelly * F.pi(), 9).alias("kelly_pi")
    )


@query(
    "kelly_topk_racecap",
    "SELECT strategy_id, race_id, kumiban, bet FROM raced",
    ["raced"],
)
def kelly_topk_racecap(t: Tables) -> DataFrame:
    return wager.race_stakes(candidates(t), most=MOST_BETS).select("strategy_id", "race_id", "kumiban", "bet")


@query(
    "daily_cap_fold",
    "SELECT strategy_id, race_id, kumiban, bet FROM capped",
    ["capped"],
)
def daily_cap_fold(t: Tables) -> DataFrame:
    staked = wager.race_stakes(candidates(t), most=MOST_BETS)
    return wager.daily_cap(staked).select("strategy_id", "race_id", "kumiban", "bet")


@query(
    "settlement",
    """
    SELECT strategy_id, race_id, kumiban, bet, per_100 AS payout_yen_per_100, is_hit, payout, profit FROM settled
    """,
    ["settled"],
)
def settlement(t: Tables) -> DataFrame:
    return settled(t).select(
        "strategy_id", "race_id", "kumiban", "bet", "payout_yen_per_100", "is_hit", "payout", "profit"
    )


@query(
    "bet_ledger",
    """
    SELECT strategy_id, strftime(race_date, '%Y-%m-%d') AS race_date, race_id, kumiban, horse_no_1, horse_no_2,
           CASE WHEN horse_no_1 % 4 = 0 THEN '馬番' || horse_no_1 ELSE 'H' || horse_no_1 END || ' / ' ||
           CASE WHEN horse_no_2 % 4 = 0 THEN '馬番' || horse_no_2 ELSE 'H' || horse_no_2 END AS horse_name,
           round(p_wide, 6) AS p_wide, CAST(odds AS DOUBLE) AS odds_final, bet AS bet_yen, is_hit, profit
    FROM settled
    """,
    ["settled"],
)
def bet_ledger(t: Tables) -> DataFrame:
    number = F.col("horse_no")
    named = F.when(number % 4 == 0, " ").otherwise(F.concat(F.lit("H"), number.cast("string")))
    names = t.runner.select("race_id", "horse_no", named.alias("horse_name"))
    out = wager.ledger(wager.runner_names(settled(t), names))
    return out.select(
        "strategy_id", "race_date", "race_id", "kumiban", "horse_no_1", "horse_no_2", "horse_name", "p_wide",
        "odds_final", "bet_yen", "is_hit", "profit",
    )


@query(
    "ledger_monthly",
    """
    SELECT strategy_id, strftime(race_date, '%Y-%m') AS month, count(*) AS n_bets, count(*) FILTER (is_hit) AS n_hits,
           CAST(sum(bet) AS BIGINT) AS total_bet, CAST(sum(payout) AS BIGINT) AS total_return,
           round_even(sum(payout) / sum(bet), 4) AS roi
    FROM settled GROUP BY ALL
    """,
    ["settled"],
)
def ledger_monthly(t: Tables) -> DataFrame:
    return wager.monthly(settled(t))


cte(
    "falls",
    """
    SELECT strategy_id, max(greatest(max_so_far, 0) - e) AS max_drawdown FROM (
        SELECT strategy_id, e, max(e) OVER (PARTITION BY strategy_id ORDER BY race_date, race_id
                                            ROWS UNBOUNDED PRECEDING) AS max_so_far
        FROM (SELECT strategy_id, race_date, race_id, sum(p) OVER (PARTITION BY strategy_id ORDER BY race_date, race_id) AS e
              FROM (SELECT strategy_id, race_date, race_id, sum(profit) AS p FROM settled GROUP BY ALL)))
    GROUP BY strategy_id
    """,
    "settled",
)


@query("drawdown", "SELECT strategy_id, CAST(max_drawdown AS BIGINT) AS max_drawdown FROM falls", ["falls"])
def drawdown(t: Tables) -> DataFrame:
    return wager.max_drawdown(settled(t))


@query(
    "strategy_sweep",
    """
    SELECT strategy_id, strftime(min(race_date), '%Y-%m-%d') AS period_from, strftime(max(race_date), '%Y-%m-%d') AS period_to,
           (SELECT count(DISTINCT race_id) FROM pair) AS n_races, count(*) AS n_bets, count(*) FILTER (is_hit) AS n_hits,
           CAST(sum(bet) AS BIGINT) AS total_bet, CAST(sum(payout) AS BIGINT) AS total_return,
           round_even(count(*) FILTER (is_hit) / count(*), 4) AS hit_rate, round_even(sum(payout) / sum(bet), 4) AS roi,
           any_value(CAST(max_drawdown AS BIGINT)) AS max_drawdown
    FROM settled JOIN falls USING (strategy_id) GROUP BY strategy_id
    """,
    ["settled", "falls"],
)
def strategy_sweep(t: Tables) -> DataFrame:
    return wager.summary(settled(t), t.pair)
