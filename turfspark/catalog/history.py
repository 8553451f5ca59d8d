"""History and in-race features, joins, filters and set logic over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark import constants as C
from turfspark.catalog.base import Tables, cte, query
from turfspark.functions import scalars as S
from turfspark.operators import filters, folds, history, ingroup, joins, skew
from turfspark.plans import features, registry

W730 = 730 * 1440


# --- rolling baselines -------------------------------------------------------

cte(
    "winner",
    """
    SELECT *, CASE WHEN distance_m <= 0 THEN NULL
                   WHEN distance_m <= 1000 THEN 1000 WHEN distance_m <= 1200 THEN 1200
                   WHEN distance_m <= 1400 THEN 1400 WHEN distance_m <= 1600 THEN 1600
                   WHEN distance_m <= 1800 THEN 1800 WHEN distance_m <= 2000 THEN 2000
                   WHEN distance_m <= 2200 THEN 2200 ELSE 2400 END AS distance_bucket
    FROM history WHERE finish_pos = 1
    """,
    "history",
)

_fine = "PARTITION BY track_code, surface, distance_bucket, going_bucket"
_coarse = "PARTITION BY surface, distance_bucket"
_range = f"ORDER BY post_at RANGE BETWEEN {W730} PRECEDING AND 1 PRECEDING"


@query(
    "rolling_baseline_2y",
    f"""
    SELECT race_id,
           count(time_c) OVER w AS n,
           round(sum(time_c) OVER w / (count(time_c) OVER w) / 100.0, 6) AS mean_sec,
           round(stddev_pop(time_c) OVER w / 100.0, 6) AS std_sec
    FROM winner WINDOW w AS ({_fine} {_range})
    """,
    ["winner"],
)
def rolling_baseline(t: Tables) -> DataFrame:
    keys = ["track", "surf", "dist", "going_"]
    best = history.winners(t.history.select("race_id", "race_datetime", "track_code", "surface",
                                            "distance_m", "going", "finish_pos", "horse_no", "time_sec"))
    rows = best.select(
        "race_id",
        S.epoch_seconds(F.col("race_datetime")).alias("tick"),
        F.col("track_code").alias("track"),
        F.col("surface").alias("surf"),
        F.coalesce(S.distance_bucket(F.col("distance_m")), F.lit(-1.0)).alias("dist"),
        F.coalesce(S.going_bucket(F.col("going")), F.lit(-1.0)).alias("going_"),
        "time_sec",
    )
    stats = history.rolling_stats(rows, keys, "tick", ["time_sec"], C.HISTORY_DAYS * 86400)
    return rows.join(stats, [*keys, "tick"]).select(
        "race_id",
        F.col("n_time_sec").alias("n"),
        F.round("mean_time_sec", 6).alias("mean_sec"),
        F.round("std_time_sec", 6).alias("std_sec"),
    )


cte(
    "shrunk",
    f"""
    SELECT *, n_fine / (n_fine + 20.0) * coalesce(m_fine, m_coarse)
                + (1.0 - n_fine / (n_fine + 20.0)) * m_coarse AS base_time,
              n3_fine / (n3_fine + 20.0) * coalesce(m3_fine, m3_coarse)
                + (1.0 - n3_fine / (n3_fine + 20.0)) * m3_coarse AS base_3f
    FROM (SELECT *, sum(time_c) OVER f / (count(time_c) OVER f) / 100.0 AS m_fine,
                 count(time_c) OVER f AS n_fine,
                 sum(time_c) OVER c / (count(time_c) OVER c) / 100.0 AS m_coarse,
                 sum(final3f_c) OVER f / (count(final3f_c) OVER f) / 100.0 AS m3_fine,
                 count(final3f_c) OVER f AS n3_fine,
                 sum(final3f_c) OVER c / (count(final3f_c) OVER c) / 100.0 AS m3_coarse
          FROM winner
          WINDOW f AS ({_fine} {_range}), c AS ({_coarse} {_range}))
    """,
    "winner",
)
cte(
    "baseline",
    """
    SELECT race_id, base_time AS baseline_time_sec, base_3f AS baseline_3f_sec,
           avg(time_sec - base_time) OVER d AS daily_time_bias,
           avg(final3f_sec - base_3f) OVER d AS daily_up3_bias
    FROM shrunk
    WINDOW d AS (PARTITION BY race_date, track_code, surface ORDER BY post_at, race_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """,
    "shrunk",
)


@query(
    "shrinkage_baseline",
    """
    SELECT race_id, baseline_time_sec, baseline_3f_sec FROM baseline
    """,
    ["baseline"],
)
def shrinkage_baseline(t: Tables) -> DataFrame:
    # exact sums: both engines reach the same doubles, so nothing is rounded
    return history.race_baseline(t.history).select("race_id", "baseline_time_sec", "baseline_3f_sec")


@query(
    "same_day_bias",
    """
    SELECT race_id, round(daily_time_bias, 6) AS daily_time_bias,
           round(daily_up3_bias, 6) AS daily_up3_bias FROM baseline
    """,
    ["baseline"],
)
def same_day_bias(t: Tables) -> DataFrame:
    return history.race_baseline(t.history).select(
        "race_id",
        F.round("daily_time_bias", 6).alias("daily_time_bias"),
        F.round("daily_up3_bias", 6).alias("daily_up3_bias"),
    )


cte(
    "indexed",
    """
    SELECT h.*, (b.baseline_time_sec + coalesce(daily_time_bias, 0) - time_sec)
                    * (1440.0 / nullif(distance_m, 0)) + 80.0 AS speed_index,
                (b.baseline_3f_sec + coalesce(daily_up3_bias, 0) - final3f_sec)
                    * (1440.0 / nullif(distance_m, 0)) + 80.0 AS up3_index
    FROM history h LEFT JOIN baseline b ON h.race_id = b.race_id
    """,
    "baseline",
)


@query(
    "speed_index",
    """
    SELECT race_id, horse_no, round(speed_index, 3) AS perf_speed_index,
           round(up3_index, 3) AS perf_up3_index FROM indexed
    """,
    ["indexed"],
)
def speed_index(t: Tables) -> DataFrame:
    return history.add_speed_indices(t.history).select(
        "race_id",
        "horse_no",
        F.round("perf_speed_index", 3).alias("perf_speed_index"),
        F.round("perf_up3_index", 3).alias("perf_up3_index"),
    )


# --- lags and experience -----------------------------------------------------
# A part can be in one order twice in the test data, so lags are taken over one
# row per (part, order): the lowest runner number.

cte(
    "starts",
    "SELECT * FROM indexed QUALIFY row_number() OVER (PARTITION BY horse_id, race_id ORDER BY horse_no) = 1",
    "indexed",
)
_lag = "PARTITION BY horse_id ORDER BY post_at, race_id"


def _starts(t: Tables) -> DataFrame:
    rows = history.add_speed_indices(t.history)
    columns = [c for c in rows.columns if c not in ("horse_id", "race_id")]
    one = rows.groupBy("horse_id", "race_id").agg(
        F.min_by(F.struct(*columns), F.col("horse_no")).alias("_r")
    )
    return one.select("horse_id", "race_id", "_r.*")


@query(
    "lags_1_2_3",
    f"""
    SELECT race_id, horse_id,
           lag(finish_pos, 1) OVER w AS lag1_finish_pos, lag(finish_pos, 2) OVER w AS lag2_finish_pos,
           lag(finish_pos, 3) OVER w AS lag3_finish_pos,
           round(lag(speed_index, 1) OVER w, 3) AS lag1_speed_index,
           round(lag(up3_index, 2) OVER w, 3) AS lag2_up3_index,
           lag(surface, 1) OVER w AS lag1_surface, lag(distance_m, 3) OVER w AS lag3_distance_m
    FROM starts WINDOW w AS ({_lag})
    """,
    ["starts"],
)
def lags(t: Tables) -> DataFrame:
    return history.add_lags(_starts(t)).select(
        "race_id", "horse_id", "lag1_finish_pos", "lag2_finish_pos", "lag3_finish_pos",
        F.round("lag1_speed_index", 3).alias("lag1_speed_index"),
        F.round("lag2_up3_index", 3).alias("lag2_up3_index"),
        "lag1_surface", "lag3_distance_m",
    )


@query(
    "lag_slope",
    f"""
    SELECT race_id, horse_id, round(l1 - l2, 3) AS d_speed_index_1_2,
           round(l2 - l3, 3) AS d_speed_index_2_3,
           round(CASE WHEN l2 IS NOT NULL THEN (l1 - l3) / 2.0 END, 3) AS speed_index_slope_3r
    FROM (SELECT race_id, horse_id, lag(speed_index, 1) OVER w AS l1, lag(speed_index, 2) OVER w AS l2,
                 lag(speed_index, 3) OVER w AS l3 FROM starts WINDOW w AS ({_lag}))
    """,
    ["starts"],
)
def lag_slope(t: Tables) -> DataFrame:
    rows = history.add_recent_change(history.add_lags(_starts(t)))
    names = ("d_speed_index_1_2", "d_speed_index_2_3", "speed_index_slope_3r")
    return rows.select("race_id", "horse_id", *[F.round(n, 3).alias(n) for n in names])


@query(
    "days_since_last",
    f"""
    SELECT race_id, horse_id, CAST(floor((post_at - lag(post_at) OVER w) / 1440.0) AS BIGINT) AS days_since_lag1,
           distance_m - lag(distance_m) OVER w AS lag1_distance_diff,
           CAST(CASE WHEN lag(surface) OVER w IS NULL THEN NULL
                     WHEN surface = lag(surface) OVER w THEN 1 ELSE 0 END AS DOUBLE) AS lag1_course_type_match,
           CASE WHEN lag(jockey_id) OVER w IS NOT NULL AND jockey_id > 0
                     AND jockey_id <> lag(jockey_id) OVER w THEN 1 ELSE 0 END AS is_jockey_change
    FROM starts WINDOW w AS ({_lag})
    """,
    ["starts"],
)
def days_since_last(t: Tables) -> DataFrame:
    return history.add_lags(_starts(t)).select(
        "race_id", "horse_id", "days_since_lag1", "lag1_distance_diff", "lag1_course_type_match",
        "is_jockey_change",
    )


@query(
    "history_count_730d",
    f"""
    SELECT race_id, horse_no, count(*) OVER w AS prior_starts_2y,
           CAST(floor((post_at - min(post_at) OVER w) / 1440.0) AS BIGINT) AS days_since_first_seen_2y
    FROM history WINDOW w AS (PARTITION BY horse_id {_range})
    """,
    ["history"],
)
def history_count(t: Tables) -> DataFrame:
    return history.add_experience(t.history).select(
        "race_id", "horse_no", "prior_starts_2y", "days_since_first_seen_2y"
    )


@query(
    "aptitude_same_bucket_rate",
    f"""
    SELECT race_id, horse_no,
           (coalesce(sum(is_top3) OVER d, 0) + 20e0 * 0.17e0) / (count(*) OVER d + 20.0)
               AS apt_same_distance_top3_rate_2y,
           CASE WHEN going_bucket IS NULL THEN (20e0 * 0.17e0) / 20.0
                ELSE (coalesce(sum(is_top3) OVER g, 0) + 20e0 * 0.17e0) / (count(*) OVER g + 20.0) END
               AS apt_same_going_top3_rate_2y
    FROM history
    WINDOW d AS (PARTITION BY horse_id, distance_m {_range}),
           g AS (PARTITION BY horse_id, going_bucket {_range})
    """,
    ["history"],
)
def aptitude(t: Tables) -> DataFrame:
    return history.add_aptitude(t.history).select(
        "race_id", "horse_no", "apt_same_distance_top3_rate_2y", "apt_same_going_top3_rate_2y"
    )


# --- entity rates ------------------------------------------------------------

cte(
    "daily",
    """
    SELECT jockey_id AS jockey_key, day_no, sum(is_top3) AS top3, sum(target_label) AS labels,
           count(*) AS starts
    FROM history WHERE jockey_id > 0 GROUP BY ALL
    """,
    "history",
)
cte(
    "rolled",
    """
    SELECT *, sum(top3) OVER w AS top3_6m, sum(labels) OVER w AS labels_6m, sum(starts) OVER w AS starts_6m
    FROM daily WINDOW w AS (PARTITION BY jockey_key ORDER BY day_no RANGE BETWEEN 183 PRECEDING AND 1 PRECEDING)
    """,
    "daily",
)
FROM_DATE = "1997-01-01"
cte(
    "prior",
    f"""
    SELECT coalesce(avg(CASE WHEN race_date < DATE '{FROM_DATE}' THEN target_label END), 0) AS prior
    FROM history
    """,
    "history",
)


@query(
    "entity_daily_counts",
    "SELECT jockey_key, day_no, CAST(top3 AS BIGINT) AS target_sum, starts FROM daily",
    ["daily"],
)
def entity_daily_counts(t: Tables) -> DataFrame:
    return history.entity_daily(t.history, "jockey_key", "is_top3").select(
        "jockey_key", F.col("_day").cast("bigint").alias("day_no"), "target_sum", "starts"
    )


@query(
    "entity_rate_183d",
    """
    SELECT h.race_id, h.horse_no,
           (coalesce(top3_6m, 0) + 20e0 * 0.17e0) / (coalesce(starts_6m, 0) + 20.0) AS jockey_top3_rate_6m
    FROM history h LEFT JOIN rolled r ON h.jockey_id = r.jockey_key AND h.day_no = r.day_no
    """,
    ["rolled"],
)
def entity_rate(t: Tables) -> DataFrame:
    rated = history.entity_rate(
        t.history, "jockey_key", "is_top3", "jockey_top3_rate_6m", C.PRIOR_TOP3_RATE
    )
    return rated.select("race_id", "horse_no", "jockey_top3_rate_6m")


@query(
    "target_encoding_183d",
    """
    SELECT h.race_id, h.horse_no,
           round((coalesce(labels_6m, 0) + 20.0 * prior) / (coalesce(starts_6m, 0) + 20.0), 9)
               AS jockey_target_label_mean_6m
    FROM history h LEFT JOIN rolled r ON h.jockey_id = r.jockey_key AND h.day_no = r.day_no, prior
    """,
    ["rolled", "prior"],
)
def target_encoding(t: Tables) -> DataFrame:
    slim = t.history.select("race_id", "horse_no", "race_date", "jockey_key", "target_label")
    sized = skew.attach_group(slim, ["race_id"], field_size=F.count(F.lit(1)))
    prior = history.label_prior(sized, FROM_DATE).scalar()
    rated = history.entity_rate(
        slim, "jockey_key", "target_label", "jockey_target_label_mean_6m", prior
    )
    return rated.select(
        "race_id", "horse_no", F.round("jockey_target_label_mean_6m", 9).alias("jockey_target_label_mean_6m")
    )


@query(
    "label_prior",
    f"""
    SELECT avg(CASE WHEN race_date < DATE '{FROM_DATE}' THEN target_label END) AS prior_history,
           round(avg(6.0 / field_size), 9) AS prior_field
    FROM (SELECT *, count(*) OVER (PARTITION BY race_id) AS field_size FROM history)
    """,
    ["history"],
)
def label_prior(t: Tables) -> DataFrame:
    slim = t.history.select("race_id", "race_date", "target_label")
    sized = skew.attach_group(slim, ["race_id"], field_size=F.count(F.lit(1)))
    known = history.label_prior(sized, FROM_DATE).select(F.col("prior").alias("prior_history"))
    none = history.label_prior(sized, "1900-01-01").select(F.round("prior", 9).alias("prior_field"))
    return known.withColumn("prior_field", none.scalar())


# --- in-race values ----------------------------------------------------------


@query(
    "in_group_z_rank_pct",
    """
    SELECT race_id, horse_no,
           round(CASE WHEN stddev_pop(carried_weight) OVER r = 0 THEN 0
                      ELSE (carried_weight - avg(carried_weight) OVER r) / stddev_pop(carried_weight) OVER r END, 6)
               AS weight_z,
           rank() OVER (PARTITION BY race_id ORDER BY score_c DESC)
               + (count(*) OVER (PARTITION BY race_id, score_c) - 1) / 2.0 AS score_rank,
           (rank() OVER (PARTITION BY race_id ORDER BY score_c DESC)
               + (count(*) OVER (PARTITION BY race_id, score_c) - 1) / 2.0) / count(*) OVER r AS score_pct
    FROM runner WINDOW r AS (PARTITION BY race_id)
    """,
    ["runner"],
)
def in_group_z_rank_pct(t: Tables) -> DataFrame:
    scored = ingroup.add_zscores(t.runner, {"carried_weight": "weight_z"})
    ranked = ingroup.add_rank(scored, "score_c", rank="score_rank", pct="score_pct", descending=True)
    return ranked.select(
        "race_id", "horse_no", F.round("weight_z", 6).alias("weight_z"), "score_rank", "score_pct"
    )


@query(
    "rank_with_nulls",
    """
    SELECT race_id, horse_no,
           CASE WHEN final3f_c IS NOT NULL THEN
               (rank() OVER (PARTITION BY race_id ORDER BY final3f_c NULLS LAST)
                + (count(final3f_c) OVER (PARTITION BY race_id, final3f_c) - 1) / 2.0)
               / count(final3f_c) OVER (PARTITION BY race_id) END AS pct
    FROM runner
    """,
    ["runner"],
)
def rank_with_nulls(t: Tables) -> DataFrame:
    return ingroup.add_rank(t.runner, "final3f_c", pct="pct").select("race_id", "horse_no", "pct")


@query(
    "group_share",
    """
    SELECT race_id, horse_no, CAST(sum(heavy) OVER r AS BIGINT) AS n_heavy,
           sum(heavy) OVER r / CAST(count(*) OVER r AS DOUBLE) AS share_heavy
    FROM (SELECT *, CASE WHEN carried_weight > 40 THEN 1 ELSE 0 END AS heavy FROM runner)
    WINDOW r AS (PARTITION BY race_id)
    """,
    ["runner"],
)
def group_share(t: Tables) -> DataFrame:
    rows = t.scored.withColumn("heavy", S.flag(F.col("carried_weight") > 40))
    return ingroup.add_share(rows, "heavy", "n_heavy", "share_heavy").select(
        "race_id", "horse_no", "n_heavy", "share_heavy"
    )


@query(
    "group_centered",
    """
    SELECT race_id, horse_no, round(score - avg(score) OVER (PARTITION BY race_id), 6) AS score_centered
    FROM scored
    """,
    ["scored"],
)
def group_centered(t: Tables) -> DataFrame:
    return ingroup.add_centered(t.scored, {"score": "score_centered"}).select(
        "race_id", "horse_no", F.round("score_centered", 6).alias("score_centered")
    )


# --- joins, filters, sets ----------------------------------------------------


@query(
    "base_join",
    """
    SELECT race_id, horse_no, horse_id, finish_pos, post_at * 60 AS post_epoch,
           CAST(going_bucket AS DOUBLE) AS going_bucket
    FROM history
    WHERE race_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND track_code BETWEEN 1 AND 10
    """,
    ["history"],
)
def base_join(t: Tables) -> DataFrame:
    # runner and result share the runner number here: a part may start twice in one order
    runner = t.runner.select("race_id", "horse_no", "horse_id")
    result = t.runner.select("race_id", "horse_no", "horse_id", "finish_pos")
    keyed = lambda df: df.withColumn(
        "horse_id", F.concat_ws("-", "horse_id", "horse_no")
    )
    rows = joins.base_rows(
        t.race, keyed(runner), keyed(result).drop("horse_no"), "1996-01-01", "1998-12-31"
    )
    return rows.select(
        "race_id", "horse_no", F.substring_index("horse_id", "-", 1).alias("horse_id"), "finish_pos",
        S.epoch_seconds(F.col("race_datetime")).alias("post_epoch"), "going_bucket",
    )


@query(
    "finish_positions",
    """
    SELECT race_id, horse_no, finish_pos FROM runner
    WHERE race_id IN (SELECT race_id FROM race WHERE surface = 2) AND finish_pos <= 3
    """,
    ["race", "runner"],
)
def finish_positions(t: Tables) -> DataFrame:
    dirt = t.race.filter("surface = 2").select("race_id")
    entry = F.concat_ws("-", "horse_id", "horse_no").alias("horse_id")
    runner = t.runner.select("race_id", entry, "horse_no")
    result = t.runner.select("race_id", entry, "finish_pos")
    return joins.finish_positions(runner, result, dirt).filter("finish_pos <= 3")


@query(
    "segment_filter",
    """
    SELECT race_id, horse_no FROM (
        SELECT *, count(*) OVER (PARTITION BY race_id) AS field_size FROM history)
    WHERE track_code BETWEEN 1 AND 10 AND surface = 2 AND race_type_code IN (13, 14)
      AND condition_code_min_age IN (10, 16, 999) AND distance_m > 0 AND field_size > 0
      AND horse_no BETWEEN 1 AND 18 AND finish_pos IS NOT NULL
    """,
    ["history"],
)
def segment_filter(t: Tables) -> DataFrame:
    sized = skew.attach_group(t.history, ["race_id"], field_size=F.count(F.lit(1)))
    return filters.segment(sized).select("race_id", "horse_no")


@query(
    "history_and_output_window",
    f"""
    SELECT race_id, horse_no, prior_starts FROM (
        SELECT race_id, horse_no, race_date, count(*) OVER (PARTITION BY horse_id {_range}) AS prior_starts
        FROM history WHERE race_date BETWEEN DATE '1997-01-01' - 730 AND DATE '1997-12-31')
    WHERE race_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
    """,
    ["history"],
)
def history_and_output_window(t: Tables) -> DataFrame:
    wide = filters.date_window(t.history, filters.history_start("1997-01-01"), "1997-12-31")
    counted = filters.date_window(history.add_experience(wide), "1997-01-01", "1997-12-31")
    return counted.select("race_id", "horse_no", F.col("prior_starts_2y").alias("prior_starts"))


@query(
    "year_select",
    """
    SELECT race_id, CAST(year(race_date) AS INT) AS valid_year FROM race
    WHERE year(race_date) IN (1996, 1998) AND year(race_date) < 2000
    """,
    ["race"],
)
def year_select(t: Tables) -> DataFrame:
    dated = t.race.select("race_id", F.year("race_date").alias("valid_year"))
    return folds.select_years(dated, holdout_year=2000, years=[1996, 1998], required=[1996])


@query(
    "numeric_coercion",
    """
    SELECT o_orderkey AS race_id, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level,
           TRY_CAST(split_part(o_orderpriority, '-', 2) AS DOUBLE) AS word FROM orders
    """,
)
def numeric_coercion(t: Tables) -> DataFrame:
    part = lambda i: F.split_part("o_orderpriority", F.lit("-"), F.lit(i))
    return t.read("orders").select(
        F.col("o_orderkey").alias("race_id"), S.number(part(1)).alias("level"), S.number(part(2)).alias("word")
    )


@query(
    "key_cleaning",
    """
    SELECT l_orderkey AS race_id, CAST(nullif(l_linenumber, 3) AS BIGINT) AS horse_no,
           CAST(year(o_orderdate) AS INT) AS year,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_win
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 3
    """,
)
def key_cleaning(t: Tables) -> DataFrame:
    rows = t.read("lineitem").join(t.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    raw = rows.select(
        F.col("l_orderkey").alias("race_id"),
        F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).cast("string").alias("horse_no"),
        F.col("l_partkey").alias("horse_id"),
        F.col("o_orderdate").alias("race_date"),
        F.col("l_quantity").alias("field_size"),
        F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "0").alias("y_win"),
    )
    return filters.model_rows(raw, "y_win").select("race_id", "horse_no", "year", "y_win")


@query(
    "oof_eligibility",
    """
    SELECT race_id, horse_no FROM history
    WHERE final3f_c IS NOT NULL AND going IS NOT NULL AND year(race_date) < 2000
    """,
    ["history"],
)
def oof_eligibility(t: Tables) -> DataFrame:
    rows = t.history.withColumn("year", F.year("race_date"))
    return filters.eligible(rows, ["final3f_c", "going"], 2000).select("race_id", "horse_no")


@query(
    "binary_labels",
    """
    SELECT l_orderkey AS race_id, l_linenumber AS line,
           CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS from_words,
           CASE WHEN l_tax * 100 IN (0, 1) THEN CAST(l_tax * 100 AS INT) END AS from_numbers
    FROM lineitem
    """,
)
def binary_labels(t: Tables) -> DataFrame:
    word = F.when(F.col("l_returnflag") == "R", " True").when(F.col("l_returnflag") == "A", "FALSE ").otherwise("?")
    return t.read("lineitem").select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_linenumber").alias("line"),
        S.binary_label(word).alias("from_words"),
        S.binary_label(F.col("l_tax") * 100).alias("from_numbers"),
    )


@query(
    "common_years",
    """
    SELECT CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE o_orderstatus = 'F'
    INTERSECT SELECT CAST(year(l_shipdate) AS INT) FROM lineitem
    """,
)
def common_years(t: Tables) -> DataFrame:
    done = t.read("orders").filter("o_orderstatus = 'F'").select(F.year("o_orderdate").alias("valid_year"))
    shipped = t.read("lineitem").select(F.year("l_shipdate").alias("valid_year"))
    return folds.common_years([done, shipped])


@query(
    "missing_years",
    """
    SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS year FROM lineitem
    WHERE year(l_shipdate) NOT IN (SELECT year(o_orderdate) FROM orders WHERE o_orderdate < DATE '2000-01-01')
    """,
)
def missing_years(t: Tables) -> DataFrame:
    early = t.read("orders").filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("date"))
    return folds.missing_years(
        folds.years_of(t.read("lineitem"), "l_shipdate"), folds.years_of(early, "o_orderdate")
    )


@query(
    "union_race_keys",
    """
    SELECT DISTINCT race_id FROM (
        SELECT o_orderkey AS race_id FROM orders WHERE o_orderstatus = 'F'
        UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    """,
)
def union_race_keys(t: Tables) -> DataFrame:
    done = t.read("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("race_id"))
    back = t.read("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("race_id"))
    return filters.union_keys([done, back])


@query(
    "concat_fold_outputs",
    """
    SELECT race_id, CAST(dense_rank() OVER (ORDER BY year(race_date)) AS INTEGER) AS fold_id,
           CASE WHEN year(race_date) % 2 = 0 THEN CAST(post_minute AS BIGINT) END AS post_minute,
           CASE WHEN year(race_date) % 2 = 1 THEN CAST(weather AS BIGINT) END AS weather
    FROM race
    """,
    ["race"],
)
def concat_fold_outputs(t: Tables) -> DataFrame:
    of = lambda year, fold, column: t.race.filter(F.year("race_date") == year).select(
        "race_id", F.lit(fold).alias("fold_id"), column
    )
    # the folds differ in their columns
    years = sorted(r.y for r in t.race.select(F.year("race_date").alias("y")).distinct().collect())
    return filters.concat_folds([of(y, k, "weather" if y % 2 else "post_minute") for k, y in enumerate(years, 1)])


@query(
    "stable_output_order",
    "SELECT race_id, horse_no, finish_pos FROM runner ORDER BY race_id, horse_no",
    ["runner"],
)
def stable_output_order(t: Tables) -> DataFrame:
    return filters.in_order(t.runner.select("race_id", "horse_no", "finish_pos"))


@query(
    "first_per_key",
    """
    SELECT race_id, arg_min(horse_no, finish_pos) AS horse_no, min(time_c) FILTER (finish_pos = 1) AS time_c
    FROM runner GROUP BY race_id
    """,
    ["runner"],
)
def first_per_key(t: Tables) -> DataFrame:
    return history.winners(t.runner.select("race_id", "finish_pos", "horse_no", "time_c")).select(
        "race_id", "horse_no", "time_c"
    )


# --- scalar functions --------------------------------------------------------


@query(
    "distance_and_going_buckets",
    """
    SELECT p_partkey AS part,
           CAST((SELECT min(e) FROM unnest([1000,1200,1400,1600,1800,2000,2200,2400,2600,3000,3200,3600]) u(e)
                 WHERE e >= least(d, 3600) AND d > 0) AS DOUBLE) AS distance_bucket,
           CASE WHEN g IS NULL THEN NULL WHEN g <= 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS going_bucket
    FROM (SELECT p_partkey, p_size * 100 - 300 AS d, nullif(p_size % 5, 4) AS g FROM part)
    """,
)
def distance_and_going_buckets(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.read("part").select(
        F.col("p_partkey").alias("part"),
        S.distance_bucket(size * 100 - 300).alias("distance_bucket"),
        S.going_bucket(F.nullif(size % 5, F.lit(4))).alias("going_bucket"),
    )


@query(
    "start_time_seconds",
    """
    SELECT event_id, CASE event_id % 5
             WHEN 0 THEN hour(ts) * 3600 + minute(ts) * 60
             WHEN 1 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts)
             ELSE 86340 END AS seconds
    FROM events
    """,
)
def start_time_seconds(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.date_format("ts", "HH:mm"))
        .when(kind == 1, F.date_format("ts", " HH:mm:ss "))
        .when(kind == 2, F.lit("12h30"))
        .when(kind == 3, F.lit("ab:10"))
    )
    return t.read("events").select("event_id", S.start_seconds(text).cast("bigint").alias("seconds"))


@query(
    "entity_code_and_age",
    """
    SELECT l_orderkey AS race_id, l_linenumber AS line,
           CAST(nullif(regexp_extract(CASE WHEN l_suppkey % 9 = 0 THEN 'none'
                                           ELSE 'J' || l_suppkey || '/7' END, '[0-9]+'), '') AS BIGINT) AS code,
           CASE WHEN year(l_shipdate) - (1990 + l_partkey % 20) BETWEEN 0 AND 20
                THEN CAST(year(l_shipdate) - (1990 + l_partkey % 20) AS BIGINT) END AS age
    FROM lineitem
    """,
)
def entity_code_and_age(t: Tables) -> DataFrame:
    raw = F.when(F.col("l_suppkey") % 9 == 0, "none").otherwise(
        F.concat(F.lit("J"), F.col("l_suppkey").cast("string"), F.lit("/7"))
    )
    horse = F.concat((1990 + F.col("l_partkey") % 20).cast("string"), F.lit("001234"))
    return t.read("lineitem").select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_linenumber").alias("line"),
        S.first_digits(raw).alias("code"),
        S.age_from_id(F.col("l_shipdate"), horse).cast("bigint").alias("age"),
    )


@query(
    "season_and_age_gap",
    """
    SELECT race_id, horse_no, round(sin(2 * pi() * (month(race_date) - 1) / 12.0), 6) AS race_month_sin,
           round(cos(2 * pi() * (month(race_date) - 1) / 12.0), 6) AS race_month_cos,
           CAST(min_age AS DOUBLE) AS min_age_numeric, CAST(age - min_age AS DOUBLE) AS age_minus_min_age,
           CASE WHEN age = 3 THEN 1 ELSE 0 END AS is_3yo,
           CASE WHEN age - min_age = 0 THEN 1 ELSE 0 END AS is_min_age_runner
    FROM (SELECT *, CASE WHEN year(race_date) - (1990 + part % 8) BETWEEN 0 AND 20
                         THEN year(race_date) - (1990 + part % 8) END AS age,
                 CASE WHEN condition_code_3yo > 0 THEN 3 WHEN condition_code_4yo > 0 THEN 4 END AS min_age
          FROM history)
    """,
    ["history"],
)
def season_and_age_gap(t: Tables) -> DataFrame:
    raw = t.history.withColumns({"jockey_code_raw": F.lit(None).cast("string"),
                                 "trainer_code_raw": F.lit(None).cast("string")})
    out = features.runner_values(raw)
    return out.select(
        "race_id", "horse_no", F.round("race_month_sin", 6).alias("race_month_sin"),
        F.round("race_month_cos", 6).alias("race_month_cos"), "min_age_numeric",
        F.col("age_minus_min_age").cast("double").alias("age_minus_min_age"), "is_3yo", "is_min_age_runner",
    ).withColumn("horse_no", F.col("horse_no").cast("bigint"))


@query(
    "target_labels",
    """
    SELECT race_id, horse_no, target_label, CASE WHEN target_label = 3 THEN 1 ELSE 0 END AS y_win,
           CASE WHEN target_label >= 1 THEN 1 ELSE 0 END AS y_place, is_top3 AS y_top3
    FROM history
    """,
    ["history"],
)
def target_labels(t: Tables) -> DataFrame:
    label = S.target_label(F.col("finish_pos"))
    rows = t.runner.withColumns({"target_label": label, "y_win": S.flag(label == 3), "y_place": S.flag(label >= 1),
                                 "race_date": F.lit("2000-01-01"), "field_size": F.lit(1)})
    return filters.ranking_rows(rows).select("race_id", "horse_no", "target_label", "y_win", "y_place", "y_top3")


@query(
    "report_text_and_rounding",
    """
    SELECT p_partkey AS part, trim(regexp_replace(lower(p_name || ' & ' || p_type), '[^0-9a-z]+', '_', 'g'), '_') AS slug,
           CASE p_size % 4 WHEN 0 THEN 'shiba' WHEN 1 THEN 'dirt' WHEN 2 THEN 'dirt' END AS surface,
           round_even(p_retailprice / 8, 2) AS rounded
    FROM part
    """,
)
def report_text_and_rounding(t: Tables) -> DataFrame:
    kind = F.col("p_size") % 4
    word = F.when(kind == 0, "芝").when(kind == 1, "2").when(kind == 2, " DIRT ").otherwise("sand")
    return t.read("part").select(
        F.col("p_partkey").alias("part"),
        S.slug(F.concat_ws(" & ", "p_name", "p_type")).alias("slug"),
        S.surface_word(word).alias("surface"),
        S.round_report(F.col("p_retailprice") / 8, 2).alias("rounded"),
    )


# --- whole feature table -----------------------------------------------------


def core_tables(t: Tables) -> dict[str, DataFrame]:
    """The test tables as the core tables the feature plan reads."""
    entry = F.concat("horse_id", F.lit("-"), F.col("horse_no").cast("string")).alias("horse_id")
    sized = skew.attach_group(t.runner.select("race_id"), ["race_id"], field_size=F.count(F.lit(1)))
    race = t.race.join(sized.distinct(), "race_id")
    runner = t.runner.select(
        "race_id", "horse_id", "horse_no", "jockey_id", "trainer_id", "carried_weight",
        (400 + F.col("part") % 100).alias("body_weight"), (F.col("part") % 9 - 4).alias("body_weight_diff"),
        F.lit(None).cast("string").alias("jockey_code_raw"), F.lit(None).cast("string").alias("trainer_code_raw"),
        (1 + F.col("part") % 3).alias("sex"),
    )
    one = runner.groupBy("race_id", "horse_id").agg(
        F.min_by(F.struct(*[c for c in runner.columns if c not in ("race_id", "horse_id")]), F.col("horse_no")).alias("r")
    ).select("race_id", "horse_id", "r.*")
    result = t.runner.groupBy("race_id", "horse_id").agg(
        F.min_by(F.struct("finish_pos", (F.col("time_c") / 100.0).alias("time_sec"),
                          (F.col("final3f_c") / 100.0).alias("final3f_sec")), F.col("horse_no")).alias("r")
    ).select("race_id", "horse_id", "r.*")
    keys = one.select("race_id", "horse_no", "jockey_id")
    mining = lambda a, b: keys.select("race_id", "horse_no", (F.col("jockey_id") * 7 + 800).alias(a), (1 + F.col("horse_no") % 9).alias(b))
    live = lambda a, b: mining(a, b).filter("race_id % 2 = 0").withColumns(
        {"data_create_ymd": F.lit("19700101"), "data_create_hm": F.lit("0900"), a: F.col(a) + 1}
    )
    return {
        "race": race, "runner": one, "result": result,
        "mining_dm": mining("dm_time_x10", "dm_rank"), "mining_tm": mining("tm_score", "tm_rank"),
        "rt_mining_dm": live("dm_time_x10", "dm_rank"), "rt_mining_tm": live("tm_score", "tm_rank"),
    }


@query("feature_table")
def feature_table(t: Tables) -> DataFrame:
    # from where the history window is full to the last race
    first, last = t.race.agg(F.date_add(F.min("race_date"), C.HISTORY_DAYS).cast("string"), F.max("race_date").cast("string")).first()
    if first is None:
        first = last = "1970-01-01"
    return features.base_features(core_tables(t), first, last, with_te=True)


@query(
    "output_contract",
    f"""
    SELECT count(*) AS rows, {len(registry.output_columns(with_te=True))} AS columns
    FROM (SELECT DISTINCT race_id, horse_id FROM history
          WHERE race_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND surface = 2
            AND race_type_code IN (13, 14) AND condition_code_min_age IN (10, 16, 999) AND horse_no <= 18)
    """,
    ["history"],
)
def output_contract(t: Tables) -> DataFrame:
    # the dates of its SQL
    table = features.base_features(core_tables(t), "1997-01-01", "1999-12-31", with_te=True)
    return table.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(table.columns)).alias("columns"))
