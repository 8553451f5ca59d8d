"""Keyed merges over the event log as a feed: `event_id` is the place in the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark.catalog.base import Tables, cte, query
from turfspark.functions import feed as R
from turfspark.operators import merge

cte(
    "feed",
    """
    SELECT event_id AS seq, user_id AS race_id, event_type, value,
           nullif(event_id % 7, 0) AS going, event_id % 3 AS class_code,
           nullif(event_id % 4, 0) AS turn_dir, event_id % 5 AS course_inout,
           CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 12 WHEN 2 THEN 600 ELSE 1000 + event_id % 9 * 100 END
               AS distance_m,
           event_id % 4 AS surface, CASE WHEN event_id % 5 > 1 THEN '10:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':00' END
               AS start_time
    FROM events
    """,
)


def feed(t: Tables) -> DataFrame:
    e = F.col("event_id")
    minute = F.format_string("10:%02d:00", e % 60)
    return t.read("events").select(
        e.alias("seq"),
        F.col("user_id").alias("race_id"),
        "event_type",
        "value",
        F.nullif(e % 7, F.lit(0)).alias("going"),
        (e % 3).alias("class_code"),
        F.nullif(e % 4, F.lit(0)).alias("turn_dir"),
        (e % 5).alias("course_inout"),
        F.when(e % 6 == 0, 0).when(e % 6 == 1, 12).when(e % 6 == 2, 600).otherwise(1000 + e % 9 * 100).alias("distance_m"),
        (e % 4).alias("surface"),
        F.when(e % 5 > 1, minute).alias("start_time"),
    )


@query(
    "lww_merge",
    """
    SELECT race_id, event_type, value, going FROM feed
    QUALIFY row_number() OVER (PARTITION BY race_id, event_type ORDER BY seq DESC) = 1
    """,
    ["feed"],
)
def lww_merge(t: Tables) -> DataFrame:
    rows = feed(t).select("race_id", "event_type", "value", "going", "seq")
    return merge.last_write(rows, ["race_id", "event_type"])


@query(
    "columnwise_merge",
    """
    SELECT race_id, max_by(going, seq) FILTER (going IS NOT NULL) AS going,
           max_by(start_time, seq) FILTER (start_time IS NOT NULL) AS start_time,
           coalesce(max_by(class_code, seq) FILTER (class_code <> 0), 0) AS class_code,
           min_by(turn_dir, seq) FILTER (turn_dir IS NOT NULL) AS turn_dir,
           coalesce(min_by(course_inout, seq) FILTER (course_inout <> 0), 0) AS course_inout
    FROM feed GROUP BY race_id
    """,
    ["feed"],
)
def columnwise_merge(t: Tables) -> DataFrame:
    return _race(t).select("race_id", "going", "start_time", "class_code", "turn_dir", "course_inout")


def _race(t: Tables) -> DataFrame:
    one = F.lit(1)
    rows = feed(t).withColumns(
        {"race_date": F.lit("2024-01-01").cast("date"), "track_code": one, "race_no": one}
        | {c: F.lit(None).cast("int") for c in (
            "weather", "field_size", "grade_code", "race_type_code", "weight_type_code",
            "condition_code_min_age", "condition_code_2yo", "condition_code_3yo",
            "condition_code_4yo", "condition_code_5up", "condition_code_min_age_raw")}
    )
    return merge.merge_race(rows)


# an independent answer: replay the updates one after another
cte(
    "replay",
    """
    WITH RECURSIVE ordered AS (
        SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY seq) AS n FROM feed),
    state AS (
        SELECT race_id, n, surface, distance_m, start_time FROM ordered WHERE n = 1
        UNION ALL
        SELECT o.race_id, o.n,
               CASE WHEN o.surface > 0 AND (s.surface = 0 OR s.distance_m = 0 OR s.start_time IS NULL)
                    THEN o.surface ELSE s.surface END,
               CASE WHEN o.distance_m > 0 AND (s.distance_m = 0 OR s.distance_m < 800)
                    THEN o.distance_m ELSE s.distance_m END,
               coalesce(o.start_time, s.start_time)
        FROM state s JOIN ordered o ON o.race_id = s.race_id AND o.n = s.n + 1)
    SELECT race_id, surface, distance_m FROM state
    QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY n DESC) = 1
    """,
    "feed",
)


@query("guarded_merge", "SELECT race_id, surface, distance_m FROM replay", ["replay"])
def guarded_merge(t: Tables) -> DataFrame:
    return _race(t).select("race_id", "surface", "distance_m")


# replay the records of each race one after another
cte(
    "pinned",
    """
    WITH RECURSIVE placed AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY seq) AS n FROM feed),
    replay AS (
        SELECT DISTINCT race_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(no VARCHAR, id BIGINT)[]) AS held,
               CAST(NULL AS BIGINT) AS who
        FROM feed
        UNION ALL
        SELECT race_id, n,
               CASE WHEN holder IS NULL AND going IS NOT NULL
                    THEN list_append(list_filter(held, lambda h: h.id <> going), {'no': event_type, 'id': going})
                    ELSE held END,
               coalesce(holder, going)
        FROM (SELECT p.race_id, p.n, p.event_type, p.going, r.held,
                     list_filter(r.held, lambda h: h.no = p.event_type)[1].id AS holder
              FROM replay r JOIN placed p ON p.race_id = r.race_id AND p.n = r.n + 1))
    SELECT race_id, event_type, who, value, seq FROM replay JOIN placed USING (race_id, n)
    """,
    "feed",
)


@query(
    "first_key_pin",
    """
    SELECT race_id, event_type, who AS first, count(*) AS records, max_by(value, seq) AS value
    FROM pinned GROUP BY race_id, event_type, who
    """,
    ["pinned"],
)
def first_key_pin(t: Tables) -> DataFrame:
    pinned = merge.pin_identity(feed(t), ["race_id", "event_type"], "going")
    return pinned.groupBy("race_id", "event_type", F.col("going").alias("first")).agg(
        F.count(F.lit(1)).alias("records"), F.max_by("value", "seq").alias("value")
    )


@query(
    "dimension_merge",
    """
    SELECT key, max_by(name, seq) FILTER (name IS NOT NULL) AS name FROM (
        SELECT user_id AS key, CASE WHEN event_id % 3 > 0 THEN event_type END AS name, event_id AS seq FROM events
        UNION ALL SELECT s_suppkey, s_name, -1 FROM supplier)
    GROUP BY key
    """,
)
def dimension_merge(t: Tables) -> DataFrame:
    named = F.when(F.col("event_id") % 3 > 0, F.col("event_type"))
    seen = t.read("events").select(F.col("user_id").alias("key"), named.alias("name"), F.col("event_id").alias("seq"))
    master = t.read("supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit(-1).cast("bigint").alias("seq")
    )
    return merge.merge_dimension([seen, master], "key", "name")


@query(
    "fk_guard",
    """
    SELECT l_orderkey AS race_id, l_linenumber AS line, l_partkey AS part,
           CASE WHEN l_returnflag <> 'A' AND s_suppkey IS NOT NULL THEN l_suppkey END AS jockey_id
    FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0) ON l_suppkey = s_suppkey
    """,
)
def fk_guard(t: Tables) -> DataFrame:
    known = t.read("supplier").filter("s_suppkey % 10 <> 0")
    rows = t.read("lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("jockey_id"), "l_returnflag",
    )
    out = merge.guard_reference(rows, known, "jockey_id", "s_suppkey", void=F.col("l_returnflag") == "A")
    return out.drop("l_returnflag")


_id = "(year({0}) * 10000 + month({0}) * 100 + day({0})) * 10000 + (1 + {1} % 12) * 100 + (1 + {1} % 12)"


@query(
    "stub_rows",
    f"""
    WITH ids AS (SELECT DISTINCT {_id.format("o_orderdate", "o_custkey")} AS race_id,
                        CAST(o_orderdate AS DATE) AS race_date, 1 + o_custkey % 12 AS code,
                        max(o_orderstatus = 'F') OVER (PARTITION BY o_orderdate, o_custkey % 12) AS real
                 FROM orders)
    SELECT race_id, race_date, code AS track_code, code AS race_no, CASE WHEN real THEN 2 ELSE 0 END AS surface,
           CASE WHEN real THEN 1200 ELSE 0 END AS distance_m
    FROM ids
    """,
)
def stub_rows(t: Tables) -> DataFrame:
    code = 1 + F.col("o_custkey") % 12
    day = F.col("o_orderdate").cast("date")
    ids = t.read("orders").select(
        R.make_race_id(day, code, code).alias("race_id"), day.alias("race_date"), code.cast("int").alias("track_code"),
        code.cast("int").alias("race_no"), "o_orderstatus",
    )
    races = ids.filter("o_orderstatus = 'F'").drop("o_orderstatus").distinct().withColumns(
        {"surface": F.lit(2), "distance_m": F.lit(1200)}
    )
    return merge.race_stubs(races, [ids.select("race_id")])


@query(
    "race_key_decode_and_scope",
    f"""
    SELECT race_id, track, number, day, track BETWEEN 1 AND 10 AND day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AS in_scope
    FROM (SELECT DISTINCT {_id.format("o_orderdate", "o_custkey")} AS race_id, 1 + o_custkey % 12 AS track,
                 1 + o_custkey % 12 AS number, CAST(o_orderdate AS DATE) AS day FROM orders)
    """,
)
def race_key_decode(t: Tables) -> DataFrame:
    code = 1 + F.col("o_custkey") % 12
    ids = t.read("orders").select(R.make_race_id(F.col("o_orderdate").cast("date"), code, code).alias("race_id")).distinct()
    race_id = F.col("race_id")
    return ids.select(
        "race_id", R.race_id_track(race_id).alias("track"), R.race_id_number(race_id).alias("number"),
        R.race_id_date(race_id).alias("day"), R.in_history_scope(race_id, "1996-01-01", "1999-12-31").alias("in_scope"),
    )


@query(
    "header_detail_split",
    """
    SELECT race_id, day, event_type, value, last_value FROM (
        SELECT race_id, event_id // 50 AS day, event_type, max_by(value, event_id) AS value FROM
            (SELECT *, user_id AS race_id FROM events) GROUP BY ALL)
    JOIN (SELECT user_id AS race_id, event_id // 50 AS day, max_by(value, event_id) AS last_value
          FROM events GROUP BY ALL) USING (race_id, day)
    """,
)
def header_detail_split(t: Tables) -> DataFrame:
    rows = t.read("events").select(
        F.col("user_id").alias("race_id"), F.floor(F.col("event_id") / 50).alias("day"), "event_type", "value",
        F.col("value").alias("last_value"), F.col("event_id").alias("seq"),
    )
    header, detail = merge.split_header(rows, ["race_id", "day"], ["last_value"], ["value"], ["event_type"])
    return detail.join(header, ["race_id", "day"])


@query(
    "tombstone_apply",
    """
    SELECT race_id, event_type, value FROM feed f
    WHERE event_type <> 'error' AND seq > coalesce(
        (SELECT max(seq) FROM feed d WHERE d.event_type = 'error' AND d.race_id = f.race_id), -1)
    QUALIFY row_number() OVER (PARTITION BY race_id, event_type ORDER BY seq DESC) = 1
    """,
    ["feed"],
)
def tombstone_apply(t: Tables) -> DataFrame:
    rows = feed(t).select("race_id", "event_type", "value", "seq")
    alive = merge.apply_tombstones(
        rows.filter("event_type <> 'error'"), rows.filter("event_type = 'error'"), ["race_id"]
    )
    return merge.last_write(alive, ["race_id", "event_type"])


_target = """race_date >= DATE '1996-01-01' AND track_code BETWEEN 1 AND 10 AND surface = 2
             AND race_type_code IN (13, 14) AND condition_code_min_age IN (10, 16, 999)"""


cte("target", f"SELECT race_id FROM race WHERE {_target}", "race")


@query(
    "semi_prune",
    f"""
    SELECT l_orderkey AS race_id, l_linenumber AS line, l_partkey AS part FROM lineitem
    WHERE l_orderkey IN (SELECT race_id FROM race WHERE {_target})
    """,
    ["race"],
)
def semi_prune(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")
    )
    return merge.prune(rows, merge.target_races(t.race, "1996-01-01"))


@query(
    "prune_counts",
    """
    SELECT 'payout' AS table_name, count(*) AS rows_before, count(target.race_id) AS rows_after,
           count(*) - count(target.race_id) AS rows_deleted
    FROM lineitem LEFT JOIN target ON l_orderkey = target.race_id
    UNION ALL SELECT 'o1_header', count(*), count(target.race_id), count(*) - count(target.race_id)
    FROM race LEFT JOIN target ON race.race_id = target.race_id
    """,
    ["target"],
)
def prune_counts(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("race_id"))
    return merge.prune_counts({"payout": rows, "o1_header": t.race}, merge.target_races(t.race, "1996-01-01"))


@query(
    "rebuild_summary",
    """
    SELECT 'rows' AS section, 'race' AS item, CAST(count(*) AS VARCHAR) AS value FROM race
    UNION ALL SELECT 'rows', 'runner', CAST(count(*) AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'dates', 'min_race_date', CAST(min(race_date) AS VARCHAR) FROM race
    UNION ALL SELECT 'dates', 'max_race_date', CAST(max(race_date) AS VARCHAR) FROM race
    UNION ALL SELECT 'masters', 'horses', CAST(count(DISTINCT l_partkey) AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'masters', 'jockeys', CAST(count(DISTINCT l_suppkey) AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'masters', 'trainers', CAST(count(DISTINCT l_suppkey % 37) AS VARCHAR) FROM lineitem
    """,
    ["race"],
)
def rebuild_summary(t: Tables) -> DataFrame:
    runner = t.read("lineitem").select(
        F.col("l_partkey").alias("horse_id"), F.col("l_suppkey").alias("jockey_id"),
        (F.col("l_suppkey") % 37).alias("trainer_id"),
    )
    return merge.rebuild_summary(t.race, runner, {"race": t.race, "runner": runner})
