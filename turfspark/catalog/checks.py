"""Data checks, folds, model selection, run comparison and streams over the test tables."""

from __future__ import annotations


from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark.catalog.base import Tables, cte, query
from turfspark.catalog.market import TYPES
from turfspark.operators import folds, joins, quality, selection
from turfspark.session import shared_folder
from turfspark.streaming import odds as stream_odds


# --- data checks -------------------------------------------------------------


@query(
    "duplicate_keys",
    """
    SELECT l_orderkey AS race_id, l_linenumber AS horse_no, count(*) AS rows FROM lineitem
    GROUP BY ALL HAVING count(*) > 1
    """,
)
def duplicate_keys(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("horse_no"))
    return quality.duplicate_keys(rows, ["race_id", "horse_no"])


@query(
    "future_references",
    """
    SELECT l_orderkey AS race_id, l_linenumber AS line, l_shipdate < o_orderdate AS early
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate
    """,
)
def future_references(t: Tables) -> DataFrame:
    rows = t.read("lineitem").join(t.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = quality.future_references(rows, [("o_orderdate", "l_shipdate")])
    return found.select(
        F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("line"),
        (F.col("l_shipdate") < F.col("o_orderdate")).alias("early"),
    )


@query(
    "referential_integrity",
    """
    SELECT 'runner to race' AS link, count(*) AS orphans FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
    UNION ALL SELECT 'runner to jockey', count(*) FROM lineitem
    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0)
    """,
)
def referential_integrity(t: Tables) -> DataFrame:
    runner = t.read("lineitem").select(F.col("l_orderkey").alias("race_id"), F.col("l_suppkey").alias("jockey_id"))
    race = t.read("orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("race_id"))
    jockey = t.read("supplier").filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("jockey_id"))
    return quality.orphan_counts(
        {"runner to race": (runner, race, ["race_id"]), "runner to jockey": (runner, jockey, ["jockey_id"])}
    )


@query(
    "constant_per_group",
    """
    SELECT race_id, unnest(list_filter([CASE WHEN a > 1 THEN 'l_returnflag' END, CASE WHEN b > 1 THEN 'l_tax' END],
                           lambda x: x IS NOT NULL)) AS column
    FROM (SELECT l_orderkey AS race_id, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_tax) AS b
          FROM lineitem GROUP BY l_orderkey)
    """,
)
def constant_per_group(t: Tables) -> DataFrame:
    rows = t.read("lineitem").withColumnRenamed("l_orderkey", "race_id")
    return quality.not_constant(rows, "race_id", ["l_returnflag", "l_tax"])


@query(
    "pair_input_violations",
    """
    SELECT race_id, horse_no_1, horse_no_2, rule FROM (
        SELECT *, part_1 % 50 AS h1, part_2 % 50 AS h2 FROM pair), unnest(list_filter([
            CASE WHEN p_1 + p_2 > 1 THEN 'probability outside [0, 1]' END,
            CASE WHEN h1 = h2 THEN 'members equal' END,
            CASE WHEN kumiban <> lpad(CAST(least(h1, h2) AS VARCHAR), 2, '0') || lpad(CAST(greatest(h1, h2) AS VARCHAR), 2, '0')
                 THEN 'key does not match members' END], lambda x: x IS NOT NULL)) u(rule)
    UNION ALL
    SELECT race_id, horse_no_1, horse_no_2, 'pair repeated' FROM (
        SELECT *, count(*) OVER (PARTITION BY race_id, least(part_1 % 50, part_2 % 50), greatest(part_1 % 50, part_2 % 50)) AS n
        FROM pair) WHERE n > 1
    """,
    ["pair"],
)
def pair_input_violations(t: Tables) -> DataFrame:
    rows = t.pair.select(
        "race_id", F.col("horse_no_1").alias("a"), F.col("horse_no_2").alias("b"), "kumiban",
        (F.col("part_1") % 50).alias("horse_no_1"), (F.col("part_2") % 50).alias("horse_no_2"),
        (F.col("p_1") + F.col("p_2")).alias("p_wide"),
    )
    found = quality.pair_violations(rows).select("race_id", "kumiban", "rule")
    key = F.col("kumiban")
    return found.select(
        "race_id", F.substring(key, 1, 2).cast("bigint").alias("horse_no_1"),
        F.substring(key, 3, 2).cast("bigint").alias("horse_no_2"), "rule",
    )


@query(
    "coverage_report",
    """
    SELECT 'final3f_c' AS "column", count(final3f_c) / count(*) AS coverage FROM runner
    UNION ALL SELECT 'time_c', count(time_c) / count(*) FROM runner
    UNION ALL SELECT 'carried_weight', count(nullif(carried_weight, 7)) / count(*) FROM runner
    """,
    ["runner"],
)
def coverage_report(t: Tables) -> DataFrame:
    rows = t.runner.withColumn("carried_weight", F.nullif("carried_weight", F.lit(7.0)))
    return quality.coverage(rows, ["final3f_c", "time_c", "carried_weight"]).select("column", "coverage")


@query(
    "output_summary",
    """
    SELECT count(*) AS rows, count(DISTINCT race_id) AS races, min(race_date) AS first_date, max(race_date) AS last_date
    FROM race
    """,
    ["race"],
)
def output_summary(t: Tables) -> DataFrame:
    return quality.output_summary(t.race)


# --- folds -------------------------------------------------------------------

HOLDOUT = 2001
cte("years", "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders")
cte("usable", f"SELECT y, row_number() OVER (ORDER BY y) AS n FROM years WHERE y < {HOLDOUT}", "years")


def _fold_sql(least: int, most: int) -> str:
    return f"""
        SELECT CAST(v.n - {least} AS BIGINT) AS fold_id, v.y AS valid_year, string_agg(t.y, ',' ORDER BY t.y) AS train_years
        FROM usable v JOIN usable t ON t.n < v.n AND t.n >= v.n - {most} WHERE v.n > {least}
        GROUP BY v.n, v.y
    """


def _years(t: Tables) -> DataFrame:
    return folds.years_of(t.read("orders"), "o_orderdate")


def _listed(frame: DataFrame) -> DataFrame:
    years = F.array_join(F.col("train_years").cast("array<string>"), ",")
    return frame.select(F.col("fold_id").cast("bigint").alias("fold_id"), "valid_year", years.alias("train_years"))


@query("year_folds", _fold_sql(3, 3), ["usable"])
def year_folds(t: Tables) -> DataFrame:
    return _listed(folds.year_folds(_years(t), HOLDOUT))


@query("stacker_folds", _fold_sql(2, 3), ["usable"])
def stacker_folds(t: Tables) -> DataFrame:
    return _listed(folds.stacker_folds(_years(t), HOLDOUT))


@query(
    "recent_years",
    f"SELECT y AS year FROM years WHERE y < {HOLDOUT} ORDER BY y DESC LIMIT 3",
    ["years"],
)
def recent_years(t: Tables) -> DataFrame:
    return folds.recent_years(_years(t), holdout_year=HOLDOUT)


@query(
    "fold_membership",
    f"""
    WITH f AS ({_fold_sql(3, 3)})
    SELECT fold_id, CASE WHEN year(o_orderdate) = valid_year THEN 'valid' ELSE 'train' END AS role, count(*) AS races
    FROM f JOIN orders ON year(o_orderdate) BETWEEN valid_year - 3 AND valid_year GROUP BY ALL
    """.replace("WITH f AS (", "SELECT * FROM (WITH f AS (", 1) + ")",
    ["usable"],
)
def fold_membership(t: Tables) -> DataFrame:
    rows = t.read("orders").select(F.col("o_orderkey").alias("race_id"), F.year("o_orderdate").alias("year"))
    members = folds.fold_members(rows, folds.year_folds(_years(t), HOLDOUT))
    return members.groupBy(F.col("fold_id").cast("bigint").alias("fold_id"), "role").agg(
        F.count(F.lit(1)).alias("races")
    )


@query(
    "fold_integrity",
    """
    SELECT 'race in train and valid' AS rule, y AS valid_year, count(DISTINCT k) AS rows
    FROM (SELECT l_orderkey AS k, year(l_shipdate) AS y, min(year(l_shipdate)) OVER (PARTITION BY l_orderkey) AS first
          FROM lineitem)
    WHERE first < y GROUP BY y
    """,
)
def fold_integrity(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("race_id"), F.year("l_shipdate").alias("year"))
    years = sorted(r.year for r in rows.select("year").distinct().collect())
    found = [
        folds.integrity_violations(rows.filter(F.col("year") < y), rows.filter(F.col("year") == y), y).withColumn(
            "valid_year", F.lit(y)
        )
        for y in years[1:]
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "year_coverage",
    f"""
    SELECT (SELECT string_agg(y, ',' ORDER BY y) FROM years) AS base_oof_years,
           (SELECT string_agg(DISTINCT year(l_shipdate), ',' ORDER BY year(l_shipdate)) FROM lineitem) AS stacker_oof_years,
           (SELECT string_agg(y, ',' ORDER BY y) FROM usable WHERE n > 3) AS pl_oof_valid_years, TRUE AS feasible
    """,
    ["usable"],
)
def year_coverage(t: Tables) -> DataFrame:
    shipped = folds.years_of(t.read("lineitem"), "l_shipdate")
    out = folds.year_coverage(_years(t), shipped, HOLDOUT)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select(text("base_oof_years"), text("stacker_oof_years"), text("pl_oof_valid_years"), "feasible")


@query(
    "policy_columns",
    f"""
    SELECT o_orderkey AS race_id, 'fixed_sliding' AS cv_window_policy, 3 AS train_window_years, {HOLDOUT} AS holdout_year,
           'train = previous 3 years only, valid = current year' AS window_definition FROM orders
    """,
)
def policy_columns(t: Tables) -> DataFrame:
    return folds.attach_policy(t.read("orders").select(F.col("o_orderkey").alias("race_id")), HOLDOUT)


# --- selection and comparison ------------------------------------------------
# a part is a trial, its orders the folds

cte(
    "trials",
    """
    SELECT l_partkey AS trial, CASE WHEN l_partkey % 5 = 0 THEN 'PRUNED' ELSE 'COMPLETE' END AS state,
           CAST(sum(CAST(l_discount * 100 AS BIGINT)) AS DOUBLE) / count(*) AS mean_logloss, CAST(median(l_quantity) AS DOUBLE) AS r2_median, min(l_quantity) AS r2_min
    FROM lineitem GROUP BY l_partkey
    """,
)


def _trials(t: Tables) -> DataFrame:
    part = F.col("l_partkey")
    return t.read("lineitem").groupBy(part.alias("trial")).agg(
        F.when(F.any_value(part) % 5 == 0, "PRUNED").otherwise("COMPLETE").alias("state"),
        (F.sum((F.round(F.col("l_discount") * 100)).cast("bigint")).cast("double") / F.count(F.lit(1))).alias("mean_logloss"),
        F.median("l_quantity").alias("r2_median"),
        F.min("l_quantity").alias("r2_min"),
    )


@query(
    "best_trial",
    """
    SELECT * FROM (SELECT trial, mean_logloss, 'constrained_logloss' AS rule FROM trials
                   WHERE state = 'COMPLETE' AND r2_median >= 25 - 0.002 AND r2_min >= 3 - 0.01
                   ORDER BY mean_logloss, trial LIMIT 1)
    UNION ALL SELECT * FROM (SELECT trial, mean_logloss, 'min_complete' FROM trials WHERE state = 'COMPLETE'
                             ORDER BY mean_logloss, trial LIMIT 1)
    UNION ALL SELECT * FROM (SELECT trial, mean_logloss, 'min_complete_fallback' FROM trials WHERE state = 'COMPLETE'
                             ORDER BY mean_logloss, trial LIMIT 1)
    """,
    ["trials"],
)
def best_trial(t: Tables) -> DataFrame:
    trials = _trials(t)
    parts = [
        selection.best_trial(trials, task="win", baseline_median=25.0, baseline_min=3.0),
        selection.best_trial(trials, task="place"),
        selection.best_trial(trials, task="win", baseline_median=900.0, baseline_min=900.0),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("trial", "mean_logloss", "rule")


@query(
    "metric_flatten",
    """
    SELECT event_id, 'n' AS key, CAST(event_id AS DOUBLE) AS value FROM events
    UNION ALL SELECT event_id, 'a.b', value FROM events
    UNION ALL SELECT event_id, 'a.c.d', CAST(user_id AS DOUBLE) FROM events
    """,
)
def metric_flatten(t: Tables) -> DataFrame:
    inner = F.struct(F.struct(F.col("user_id").alias("d")).alias("c"), F.col("value").alias("b"))
    document = F.struct(
        F.col("event_id").alias("n"), inner.alias("a"), F.lit(True).alias("flag"), F.lit("x").alias("text"),
        F.array(F.lit(1), F.lit(2)).alias("list"),
    )
    return selection.flatten_json(t.read("events").select("event_id", F.to_json(document).alias("doc")), "doc", ["event_id"])


@query(
    "run_compare",
    """
    SELECT l.section, l.key, l.value AS left_value, r.value AS right_value, r.value - l.value AS delta
    FROM (SELECT event_type AS section, CAST(user_id AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM events
          WHERE event_id % 2 = 0 GROUP BY ALL) l
    JOIN (SELECT event_type AS section, CAST(user_id AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM events
          WHERE event_id % 2 = 1 GROUP BY ALL) r USING (section, key)
    """,
)
def run_compare(t: Tables) -> DataFrame:
    run = F.when(F.col("event_id") % 2 == 0, "first").otherwise("second")
    metrics = t.read("events").groupBy(
        run.alias("run_id"), F.col("event_type").alias("section"), F.col("user_id").cast("string").alias("key")
    ).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return selection.compare_runs(metrics, "first", "second")


# --- streams -----------------------------------------------------------------


def _event_stream(t: Tables) -> DataFrame:
    schema = t.read("events").schema
    files = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    number = F.array_position(F.array(*[F.lit(x) for x in TYPES]), F.col("event_type"))
    noon = F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("interval 12 hours")
    return files.select(
        F.col("user_id").alias("race_id"), number.alias("horse_no"), "value", (1 + F.col("event_id") % 4).alias("data_kbn"),
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("announce_ts"), noon.alias("race_ts"),
        (F.col("event_id") % 9 == 0).alias("is_deleted"),
    )


@query(
    "stream_current_snapshot",
    """
    SELECT race_id, horse_no, value FROM (
        SELECT user_id AS race_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                                   WHEN 'signup' THEN 4 ELSE 5 END AS horse_no, value, event_id
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
    WHERE event_id % 9 <> 0
    """,
)
def stream_current_snapshot(t: Tables) -> DataFrame:
    root = shared_folder(t.spark)
    stream = _event_stream(t).select("race_id", "horse_no", "value", "seq", "is_deleted", "announce_ts")
    job = stream_odds.current_snapshot(stream, f"{root}/table", ["race_id", "horse_no"], f"{root}/checkpoint")
    job.awaitTermination()
    last = job.lastProgress.batchId if job.lastProgress else 0
    return stream_odds.read_snapshot(t.spark, f"{root}/table", last).select("race_id", "horse_no", "value")


@query(
    "stream_asof_snapshot",
    """
    SELECT race_id, horse_no, day, max_by(value, event_id) AS value FROM (
        SELECT user_id AS race_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                                   WHEN 'signup' THEN 4 ELSE 5 END AS horse_no, value, event_id,
               CAST(ts AS DATE) AS day
        FROM events WHERE ts <= date_trunc('day', ts) + INTERVAL 710 MINUTE AND value > 0)
    GROUP BY ALL
    """,
)
def stream_asof_snapshot(t: Tables) -> DataFrame:
    root = shared_folder(t.spark)
    chosen = stream_odds.asof_stream(_event_stream(t), 10, ["value"])
    stream_odds.write_updates(chosen, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    rows = stream_odds.read_updates(t.spark, f"{root}/table", ["race_id", "horse_no", "race_ts"])
    return rows.select("race_id", "horse_no", F.col("race_ts").cast("date").alias("day"), "value")


# --- checked joins -----------------------------------------------------------
# lines of one order and part come more than once in the test data; suppliers divisible by 10 are left out on the right


@query(
    "join_violations",
    """
    WITH l AS (SELECT l_orderkey AS race_id, l_partkey AS part, count(*) AS left_rows FROM lineitem GROUP BY ALL),
         r AS (SELECT l_orderkey AS race_id, l_partkey AS part, count(*) AS right_rows FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY ALL),
         b AS (SELECT race_id, part, left_rows, coalesce(right_rows, 0) AS right_rows FROM l LEFT JOIN r USING (race_id, part))
    SELECT 'repeated left key' AS rule, * FROM b WHERE left_rows > 1
    UNION ALL SELECT 'repeated right key', * FROM b WHERE right_rows > 1
    UNION ALL SELECT 'row without a match', * FROM b WHERE right_rows = 0
    """,
)
def join_violations(t: Tables) -> DataFrame:
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("race_id"), F.col("l_partkey").alias("part"), "l_suppkey")
    return joins.key_violations(lines, lines.filter("l_suppkey % 10 <> 0"), ["race_id", "part"])


@query(
    "one_to_one_join",
    "SELECT race_id, horse_no, finish_pos, jockey_id FROM runner",
    ["runner"],
)
def one_to_one_join(t: Tables) -> DataFrame:
    keys = ["race_id", "horse_no"]
    return joins.one_to_one(t.runner.select(*keys, "finish_pos"), t.runner.select(*keys, "jockey_id"), keys)


@query(
    "prediction_join",
    """
    SELECT s.race_id, s.horse_no, CASE WHEN part % 3 <> 0 THEN p END AS p_win_gbt, CASE WHEN part % 5 <> 0 THEN score END AS p_win_forest
    FROM scored s
    """,
    ["scored"],
)
def prediction_join(t: Tables) -> DataFrame:
    rows = t.scored
    found = {
        "p_win_gbt": rows.filter("part % 3 <> 0").select("race_id", "horse_no", F.col("p").alias("p_win_gbt")),
        "p_win_forest": rows.filter("part % 5 <> 0").select("race_id", "horse_no", F.col("score").alias("p_win_forest")),
    }
    return joins.add_predictions(rows.select("race_id", "horse_no"), found)


@query(
    "columns_by_pattern",
    "SELECT race_id, horse_no, price, trainer_id, jockey_id FROM runner",
    ["runner"],
)
def columns_by_pattern(t: Tables) -> DataFrame:
    return joins.add_columns_like(t.runner.select("race_id", "horse_no", "price"), t.runner, r"^(jockey|trainer)_id$|^price$")
