"""Odds snapshots, implied probabilities and forecasts over the event log.

A user's day is a race with post time 12:00, an event type is a runner, and each
event is an announcement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark.catalog.base import Tables, cte, query
from turfspark.functions import market as M
from turfspark.functions import scalars as S
from turfspark.operators import asof, ingroup
from turfspark.plans import features

TYPES = ("click", "error", "purchase", "signup", "view")

_type_no = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(TYPES)) + " END"
cte(
    "log",
    f"""
    SELECT (year(ts) * 10000 + month(ts) * 100 + day(ts)) * 1000000 + user_id AS race_id,
           {_type_no} AS horse_no, 1 + event_id % 4 AS data_kbn, event_id,
           CAST(ts AS DATE) AS race_date,
           hour(ts) * 60 + minute(ts) AS at_minute,
           CASE WHEN event_id % 11 > 0 THEN CAST(floor(10 + value) AS BIGINT) END AS win_x10,
           CASE WHEN event_id % 13 > 0 THEN CAST(floor(10 + value / 3) AS BIGINT) ELSE 0 END AS low_x10,
           CAST(floor(12 + value / 2) AS BIGINT) AS high_x10
    FROM events
    """,
)


# ties of minute and kind are broken by nothing in the data model: keep one row for each
_ties = "race_id, horse_no, at_minute, data_kbn"
cte(
    "unique_log",
    f"""
    SELECT {_ties}, max(win_x10) AS win_x10, max_by(low_x10, event_id) AS low_x10,
           max_by(high_x10, event_id) AS high_x10 FROM log GROUP BY {_ties}
    """,
    "log",
)
cte(
    "unique_minute",
    """
    SELECT race_id, horse_no, at_minute, max_by(low_x10, event_id) AS low_x10 FROM log
    GROUP BY race_id, horse_no, at_minute
    """,
    "log",
)


def _pick(name: str, minutes: int, value: str, also: str = "") -> str:
    usable = f"at_minute <= 720 - {minutes} AND {value} > 0 {also}"
    order = "at_minute * 10 + data_kbn"
    return f"max_by({value}, {order}) FILTER ({usable}) AS {name}, max_by(data_kbn, {order}) FILTER ({usable}) AS {name}_kbn"


cte(
    "win",
    f"""
    SELECT race_id, horse_no, {_pick("x20", 20, "win_x10")}, {_pick("x15", 15, "win_x10")},
           {_pick("x10", 10, "win_x10")},
           max_by(win_x10, data_kbn * 10000 + at_minute) FILTER (at_minute <= 720 AND win_x10 > 0) AS final,
           max_by(data_kbn, data_kbn * 10000 + at_minute) FILTER (at_minute <= 720 AND win_x10 > 0) AS final_kbn
    FROM unique_log GROUP BY race_id, horse_no HAVING count(*) FILTER (at_minute <= 720 AND win_x10 > 0) > 0
    """,
    "unique_log",
)
_both = "AND high_x10 > 0"
cte(
    "place",
    f"""
    SELECT race_id, horse_no, {_pick("l20", 20, "low_x10", _both)}, {_pick("l10", 10, "low_x10", _both)},
           max_by(high_x10, at_minute * 10 + data_kbn) FILTER (at_minute <= 700 AND low_x10 > 0) AS h20,
           max_by(high_x10, at_minute * 10 + data_kbn) FILTER (at_minute <= 710 AND low_x10 > 0) AS h10
    FROM unique_log GROUP BY race_id, horse_no HAVING count(*) FILTER (at_minute <= 720 AND low_x10 > 0) > 0
    """,
    "unique_log",
)


def odds_log(t: Tables) -> DataFrame:
    ts, value, event = F.col("ts"), F.col("value"), F.col("event_id")
    day = (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("bigint")
    number = F.array_position(F.array(*[F.lit(x) for x in TYPES]), F.col("event_type"))
    return t.read("events").select(
        (day * 1_000_000 + F.col("user_id")).alias("race_id"),
        number.alias("horse_no"),
        (1 + event % 4).alias("data_kbn"),
        event.alias("seq"),
        ts.cast("date").alias("race_date"),
        F.date_format(ts, "MMddHHmm").alias("announce_mmddhhmi"),
        F.when(event % 11 > 0, F.floor(10 + value)).alias("win_odds_x10"),
        F.when(event % 13 > 0, F.floor(10 + value / 3)).otherwise(0).alias("min_odds_x10"),
        F.floor(12 + value / 2).alias("max_odds_x10"),
    )


def posts(log: DataFrame) -> DataFrame:
    return log.select("race_id", "race_date").distinct().withColumn("start_time", F.lit("12:00"))


def _unique(t: Tables) -> DataFrame:
    keys = ["race_id", "horse_no", "announce_mmddhhmi", "data_kbn"]
    return odds_log(t).groupBy(*keys).agg(
        F.max("win_odds_x10").alias("win_odds_x10"),
        F.max_by("min_odds_x10", "seq").alias("min_odds_x10"),
        F.max_by("max_odds_x10", "seq").alias("max_odds_x10"),
    )


def win_snapshots(t: Tables) -> DataFrame:
    return asof.win_snapshots(asof.with_post_time(_unique(t), posts(odds_log(t))))


def place_snapshots(t: Tables) -> DataFrame:
    return asof.place_snapshots(asof.with_post_time(_unique(t), posts(odds_log(t))))


def _register(minutes: int) -> None:
    @query(
        f"asof_latest_snapshot_t{minutes}",
        f"""
        SELECT race_id, horse_no, x{minutes} / 10.0 AS odds, x{minutes}_kbn AS data_kbn FROM win
        WHERE x{minutes} IS NOT NULL
        """,
        ["win"],
    )
    def snapshot(t: Tables) -> DataFrame:
        return win_snapshots(t).filter(F.col(f"odds_win_t{minutes}").isNotNull()).select(
            "race_id", "horse_no", F.col(f"odds_win_t{minutes}").alias("odds"),
            F.col(f"odds_win_t{minutes}_data_kbn").alias("data_kbn"),
        )


for _minutes in (10, 15, 20):
    _register(_minutes)


@query(
    "final_snapshot_priority",
    "SELECT race_id, horse_no, final / 10.0 AS odds, final_kbn AS data_kbn FROM win",
    ["win"],
)
def final_snapshot(t: Tables) -> DataFrame:
    return win_snapshots(t).select(
        "race_id", "horse_no", F.col("odds_win_final").alias("odds"),
        F.col("odds_win_final_data_kbn").alias("data_kbn"),
    )


@query(
    "announcement_times",
    """
    SELECT event_id, CAST(epoch(CASE event_id % 3 WHEN 0 THEN date_trunc('minute', ts)
               WHEN 1 THEN date_trunc('minute', ts) + INTERVAL 300 DAY - INTERVAL 1 YEAR ELSE NULL END) AS BIGINT) AS announce_epoch
    FROM events
    """,
)
def announcement_times(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.date_format("ts", "MMddHHmm")).when(
        kind == 1, F.date_format(F.col("ts") + F.make_dt_interval(days=F.lit(300)), "MMddHHmm")
    ).otherwise("1341xx00")
    return t.read("events").select(
        "event_id", S.epoch_seconds(S.announce_time(text, F.col("ts"))).alias("announce_epoch")
    )


@query(
    "implied_prob_norm",
    """
    SELECT race_id, horse_no, round(10.0 / x10, 6) AS p_raw,
           round((10.0 / x10) / sum(10.0 / x10) OVER (PARTITION BY race_id), 6) AS p_norm
    FROM win
    """,
    ["win"],
)
def implied_prob_norm(t: Tables) -> DataFrame:
    priced = ingroup.add_implied(win_snapshots(t), "odds_win_t10", "p_norm", raw="p_raw")
    return priced.select(
        "race_id", "horse_no", F.round("p_raw", 6).alias("p_raw"), F.round("p_norm", 6).alias("p_norm")
    )


cte(
    "norm",
    """
    SELECT *, (1.0 / x20) / sum(1.0 / x20) OVER (PARTITION BY race_id) AS n20,
              (1.0 / x10) / sum(1.0 / x10) OVER (PARTITION BY race_id) AS n10,
              (1.0 / final) / sum(1.0 / final) OVER (PARTITION BY race_id) AS n_final
    FROM win
    """,
    "win",
)
_clip = "least(greatest({0}, 1e-6), 1 - 1e-6)"
_logit = "ln(" + _clip + " / (1 - " + _clip + "))"


@query(
    "logit_delta",
    f"""
    SELECT race_id, horse_no,
           round(CASE WHEN n10 IS NOT NULL AND n20 IS NOT NULL
                      THEN {_logit.format("n10")} - {_logit.format("n20")} END, 5) AS d_logit_win_10_20
    FROM norm
    """,
    ["norm"],
)
def logit_delta(t: Tables) -> DataFrame:
    rows = ingroup.add_implied(win_snapshots(t), "odds_win_t20", "n20")
    rows = ingroup.add_implied(rows, "odds_win_t10", "n10")
    return rows.select(
        "race_id", "horse_no", F.round(M.logit_delta(F.col("n10"), F.col("n20")), 5).alias("d_logit_win_10_20")
    )


@query(
    "place_mid_and_width",
    """
    SELECT race_id, horse_no, round(10.0 / sqrt(l10 * h10), 6) AS place_mid_prob_t10,
           round(ln(greatest(l10, h10) / CAST(least(l10, h10) AS DOUBLE)), 6) AS place_width_log_ratio_t10,
           round(10.0 / sqrt(l10 * h10) - 10.0 / sqrt(l20 * h20), 6) AS d_place_mid_10_20
    FROM place
    """,
    ["place"],
)
def place_mid_and_width(t: Tables) -> DataFrame:
    bounds = lambda m: (F.col(f"odds_place_t{m}_lower"), F.col(f"odds_place_t{m}_upper"))
    return place_snapshots(t).select(
        "race_id",
        "horse_no",
        F.round(M.place_mid(*bounds(10)), 6).alias("place_mid_prob_t10"),
        F.round(M.place_width(*bounds(10)), 6).alias("place_width_log_ratio_t10"),
        F.round(M.place_mid(*bounds(10)) - M.place_mid(*bounds(20)), 6).alias("d_place_mid_10_20"),
    )


@query(
    "market_snapshot_features",
    f"""
    SELECT r.race_id, r.horse_no, x10 / 10.0 AS odds_win_t10, final / 10.0 AS odds_win_final,
           round(n10, 6) AS p_win_odds_t10_norm, round(n_final, 6) AS p_win_odds_final_norm,
           round(CASE WHEN n10 IS NOT NULL AND n20 IS NOT NULL
                      THEN {_logit.format("n10")} - {_logit.format("n20")} END, 5) AS d_logit_win_10_20,
           round(ln(greatest(l10, h10) / CAST(least(l10, h10) AS DOUBLE)), 6) AS place_width_log_ratio
    FROM (SELECT DISTINCT race_id, horse_no FROM log) r
    LEFT JOIN norm USING (race_id, horse_no) LEFT JOIN place USING (race_id, horse_no)
    """,
    ["norm", "place"],
)
def market_snapshot_features(t: Tables) -> DataFrame:
    runners = odds_log(t).select("race_id", "horse_no").distinct()
    log = _unique(t)
    out = features.market_features(runners, posts(odds_log(t)), log, log)
    return out.select(
        "race_id", "horse_no", "odds_win_t10", "odds_win_final",
        F.round("p_win_odds_t10_norm", 6).alias("p_win_odds_t10_norm"),
        F.round("p_win_odds_final_norm", 6).alias("p_win_odds_final_norm"),
        F.round("d_logit_win_10_20", 5).alias("d_logit_win_10_20"),
        F.round("place_width_log_ratio", 6).alias("place_width_log_ratio"),
    )


@query(
    "latest_forecast_with_fallback",
    """
    SELECT r.race_id, r.horse_no, coalesce(live, r.horse_no * 100) AS dm_time_x10
    FROM (SELECT DISTINCT race_id, horse_no FROM log) r LEFT JOIN (
        SELECT race_id, horse_no, max_by(low_x10, at_minute) AS live FROM unique_minute
        WHERE at_minute <= 720 GROUP BY race_id, horse_no) USING (race_id, horse_no)
    """,
    ["unique_minute"],
)
def latest_forecast_with_fallback(t: Tables) -> DataFrame:
    log = odds_log(t)
    stamp = F.date_format(F.col("race_date"), "yyyyMMdd")
    one = log.groupBy("race_id", "horse_no", "announce_mmddhhmi", stamp.alias("data_create_ymd")).agg(
        F.max_by("min_odds_x10", "seq").alias("dm_time_x10")
    )
    forecasts = one.withColumn("data_create_hm", F.substring("announce_mmddhhmi", 5, 4))
    live = asof.latest_forecast(forecasts, posts(log), ["dm_time_x10"])
    runners = log.select("race_id", "horse_no").distinct()
    static = runners.withColumn("dm_time_x10", F.col("horse_no") * 100)
    return asof.with_fallback(runners, live, static, ["dm_time_x10"])
