"""Fixed-width records written from the test tables and read back by the extractors.

Records are assembled with padding only; the SQL beside each query computes the
expected values straight from the source columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfspark.catalog.base import Tables, cte, query
from turfspark.plans import rebuild
from turfspark.session import shared_folder
from turfspark.sources import extract, feed

Part = tuple[int, int, Column]


def record(width: int, parts: Sequence[Part]) -> Column:
    """Blank record with texts put at their places, each cut or padded to its length."""
    pieces, at = [], 0
    for start, length, value in sorted(parts, key=lambda part: part[0]):
        if start > at:
            pieces.append(F.lit(" " * (start - at)))
        pieces.append(F.rpad(value, length, " "))
        at = start + length
    if width > at:
        pieces.append(F.lit(" " * (width - at)))
    return F.concat(*pieces)


def repeat(count: int, item: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), item), "")


def digits(value: Column, size: int) -> Column:
    return F.lpad(value.cast("string"), size, "0")


def as_feed(df: DataFrame, rec_id: str, payload: Column, seq: Column) -> DataFrame:
    """Records of one type. A feed is many files; a test table may be one, so its rows are spread."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    spread = df.repartition(tasks, seq)
    return spread.select(F.lit(rec_id).alias("rec_id"), payload.alias("payload"), seq.alias("seq"))


def okey() -> Column:
    return F.col("o_orderkey")


def cust() -> Column:
    return F.col("o_custkey")


cte(
    "keyed",
    """
    SELECT *, o_orderkey AS k, o_custkey AS c, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)) * 10000
              + (1 + o_custkey % 12) * 100 + (1 + o_orderkey % 12) AS race_id
    FROM orders
    """,
)


def race_key(date: Column = None) -> Column:
    day = F.date_format(F.col("o_orderdate") if date is None else date, "yyyyMMdd")
    return F.concat(day, digits(1 + cust() % 12, 2), F.lit("0102"), digits(1 + okey() % 12, 2))


def header(rec_id: str) -> list[Part]:
    return [(0, 2, F.lit(rec_id)), (2, 1, digits(1 + okey() % 4, 1)), (3, 8, F.date_format("o_orderdate", "yyyyMMdd")), (11, 16, race_key())]


def race_feed(t: Tables) -> DataFrame:
    parts = [
        *header("RA"),
        (614, 1, F.substring(F.lit("ABCDEFGHL_"), (okey() % 10 + 1).cast("int"), F.lit(1))),
        (616, 2, digits(11 + okey() % 5, 2)),
        (621, 1, digits(okey() % 5, 1)),
        (622, 3, digits(cust() % 3 * 5, 3)),
        (625, 3, F.when(cust() % 7 == 0, F.lit("   ")).otherwise(digits(cust() % 4 * 6, 3))),
        (628, 3, digits(cust() % 5 * 7, 3)),
        (631, 3, digits(cust() % 2 * 8, 3)),
        (634, 3, digits(okey() % 3 * 10, 3)),
        (697, 4, F.when(okey() % 3 == 0, digits(10 + okey() % 20, 4)).otherwise(digits(1000 + okey() % 20 * 100, 4))),
        (705, 2, digits(10 + okey() % 50, 2)),
        (709, 2, F.when(okey() % 2 == 0, digits(okey() % 10, 1)).otherwise("A")),
        (873, 4, F.when(okey() % 9 == 0, "2575").otherwise(F.concat(digits(9 + okey() % 8, 2), digits(okey() % 60, 2)))),
        (881, 2, F.lit("18")),
        (883, 2, digits(okey() % 19, 2)),
        (887, 1, digits(okey() % 4, 1)),
        (888, 1, digits(okey() % 5, 1)),
        (889, 1, digits(okey() % 3, 1)),
    ]
    return as_feed(t.read("orders"), "RA", record(890, parts), okey())


@query(
    "fixed_width_scalar",
    """
    SELECT k AS seq, race_id, CAST(o_orderdate AS DATE) AS race_date,
           CASE WHEN 10 + k % 50 BETWEEN 23 AND 29 THEN 2 WHEN 10 + k % 50 BETWEEN 51 AND 59 THEN 3 ELSE 1 END AS surface,
           CASE WHEN k % 3 = 0 THEN (10 + k % 20) * 100 ELSE 1000 + k % 20 * 100 END AS distance_m,
           CASE WHEN 10 + k % 50 BETWEEN 23 AND 29 OR 10 + k % 50 BETWEEN 51 AND 59 THEN nullif(k % 3, 0) ELSE nullif(k % 5, 0) END AS going,
           nullif(k % 4, 0) AS weather, CASE WHEN k % 19 > 0 THEN k % 19 ELSE 18 END AS field_size,
           CASE WHEN k % 9 > 0 THEN lpad(CAST(9 + k % 8 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':00' END AS start_time,
           CASE WHEN k % 2 = 0 THEN k % 10 ELSE 0 END AS course_inout, CASE WHEN k % 10 < 9 THEN k % 10 + 1 END AS grade_code,
           11 + k % 5 AS race_type_code, nullif(k % 5, 0) AS weight_type_code, nullif(k % 3 * 10, 0) AS condition_code_min_age,
           coalesce(CASE 11 + k % 5 WHEN 11 THEN nullif(c % 3 * 5, 0) WHEN 12 THEN three WHEN 13 THEN three
                    WHEN 14 THEN coalesce(nullif(c % 5 * 7, 0), nullif(c % 2 * 8, 0)) END, nullif(k % 3 * 10, 0),
                    nullif(c % 2 * 8, 0), nullif(c % 5 * 7, 0), three, nullif(c % 3 * 5, 0), 0) AS class_code
    FROM (SELECT *, CASE WHEN c % 7 > 0 THEN nullif(c % 4 * 6, 0) END AS three FROM keyed)
    """,
    ["keyed"],
)
def fixed_width_scalar(t: Tables) -> DataFrame:
    return extract.race(race_feed(t)).drop("track_code", "race_no", "turn_dir")


@query(
    "age_condition_side_parse",
    """
    SELECT k AS seq, race_id, c % 3 * 5 AS condition_code_2yo, CASE WHEN c % 7 > 0 THEN c % 4 * 6 END AS condition_code_3yo,
           c % 5 * 7 AS condition_code_4yo, c % 2 * 8 AS condition_code_5up, k % 3 * 10 AS condition_code_min_age_raw
    FROM keyed
    """,
    ["keyed"],
)
def age_condition_side_parse(t: Tables) -> DataFrame:
    return extract.age_conditions(race_feed(t))


def _lines(t: Tables) -> DataFrame:
    return t.read("lineitem").join(t.read("orders"), F.col("l_orderkey") == okey())


@query(
    "fixed_width_runner",
    """
    SELECT race_id, l_linenumber AS horse_no, CAST(l_partkey AS VARCHAR) AS horse_id, nullif(l_suppkey, 0) AS jockey_id,
           'T' || l_suppkey % 37 AS trainer_code_raw, CAST(l_quantity * 10 AS BIGINT) / 10.0 AS carried_weight,
           CASE WHEN l_partkey % 10 > 0 THEN 400 + l_partkey % 100 END AS body_weight,
           CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 9 - 4 AS INT) END AS body_weight_diff,
           nullif(l_partkey % 19, 0) AS finish_pos,
           CASE WHEN l_partkey % 8 > 0 THEN ((1 + l_partkey % 2) * 60 + l_partkey % 60) + l_partkey % 10 / 10.0 END AS time_sec,
           CASE WHEN l_partkey % 11 > 0 THEN (l_partkey % 11 * 30 + 30) / 10.0 END AS final3f_sec,
           nullif(l_partkey % 18, 0) AS corner4_pos, CASE WHEN l_partkey % 5 > 0 THEN '1' || l_returnflag END AS margin,
           CASE WHEN l_partkey % 5 BETWEEN 1 AND 3 THEN l_partkey % 5 END AS sex
    FROM lineitem JOIN keyed ON l_orderkey = k
    """,
    ["keyed"],
)
def fixed_width_runner(t: Tables) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    parts = [
        *header("SE"),
        (27, 1, digits(1 + part % 8, 1)),
        (28, 2, digits(F.col("l_linenumber"), 2)),
        (30, 10, part.cast("string")),
        (40, 18, F.lit("テスト　")),
        (78, 1, digits(part % 5, 1)),
        (85, 5, F.concat(F.lit("T"), (supp % 37).cast("string"))),
        (288, 3, digits((F.col("l_quantity") * 10).cast("bigint"), 3)),
        (296, 5, digits(supp, 5)),
        (324, 3, F.when(part % 10 > 0, digits(400 + part % 100, 3)).otherwise("***")),
        (328, 3, F.when(part % 9 == 0, " ").otherwise(F.format_string("%+d", part % 9 - 4))),
        (334, 2, digits(part % 19, 2)),
        (338, 4, F.when(part % 8 > 0, F.concat(digits(1 + part % 2, 1), digits(part % 60, 2), digits(part % 10, 1))).otherwise("12a4")),
        (342, 3, F.when(part % 5 > 0, F.concat(F.lit("1"), F.col("l_returnflag"))).otherwise(" ")),
        (357, 2, digits(part % 18, 2)),
        (390, 3, F.when(part % 11 > 0, digits(part % 11 * 30 + 30, 3)).otherwise("000")),
    ]
    # the name takes two bytes per character: four characters fill eight bytes of its 36
    shifted = [(s, n, v) if s <= 40 else (s - 4, n, v) for s, n, v in parts]
    out = extract.runner(as_feed(_lines(t), "SE", record(551, shifted), F.col("l_orderkey")))
    return out.filter("horse_name = 'テスト'").select(
        "race_id", "horse_no", "horse_id", "jockey_id", "trainer_code_raw", "carried_weight", "body_weight",
        "body_weight_diff", "finish_pos", "time_sec", "final3f_sec", "corner4_pos", "margin", "sex",
    )


@query(
    "fixed_width_blocks",
    """
    SELECT k AS seq, race_id, 5 AS bet_type, lpad(CAST(1 + i AS VARCHAR), 2, '0') || lpad(CAST(2 + i + k % 5 AS VARCHAR), 2, '0') AS selection,
           (k + i) % 7 * 130 * 10 AS payout_yen, nullif((k + i) % 30, 0) AS popularity
    FROM keyed, range(10) r(i) WHERE (k + i) % 7 > 0
    UNION ALL
    SELECT k, race_id, 1, lpad(CAST(1 + (k + i) % 18 AS VARCHAR), 2, '0'), 100 + k % 900, NULL FROM keyed, range(3) r(i) WHERE i <= k % 3
    UNION ALL
    SELECT k, race_id, 8, lpad(CAST(k % 100 AS VARCHAR), 6, '0'), 70 * 10, 9 FROM keyed WHERE k % 100 > 0
    """,
    ["keyed"],
)
def fixed_width_blocks(t: Tables) -> DataFrame:
    wide = repeat(10, lambda i: F.concat(
        digits(1 + i, 2), digits(2 + i + okey() % 5, 2), digits((okey() + i) % 7 * 130, 8), digits((okey() + i) % 30, 4)))
    win = repeat(3, lambda i: F.when(
        i <= okey() % 3, F.concat(digits(1 + (okey() + i) % 18, 2), digits(100 + okey() % 900, 8))).otherwise("00          "[:10]))
    trifecta = F.concat(digits(okey() % 100, 6), F.lit("00000070"), F.lit("0009"))
    parts = [*header("HR"), (52, 30, win), (293, 160, wide), (603, 18, trifecta)]
    return extract.payout(as_feed(t.read("orders"), "HR", record(964, parts), okey()))


def win_odds_feed(t: Tables) -> DataFrame:
    size = 5 + okey() % 10
    win = repeat(28, lambda i: F.when(i < size, F.concat(
        digits(i + 1, 2), F.when((okey() + i) % 7 == 0, "****").otherwise(digits(11 + (okey() * 3 + i) % 900, 4)), digits((okey() + i) % 15, 2)
    )).otherwise(" " * 8))
    place = repeat(28, lambda i: F.when(i < size + 1, F.concat(
        digits(i + 1, 2), digits(10 + (okey() + i) % 50, 4), F.when((okey() + i) % 5 == 0, "----").otherwise(digits(20 + (okey() + i) % 60, 4)),
        F.lit("  "))).otherwise("0" * 12))
    bracket = repeat(36, lambda i: F.when(i < 3, F.concat(digits(11 + i, 2), digits(30 + (okey() + i) % 9000, 5), digits(i + 1, 2))).otherwise(" " * 9))
    parts = [*header("O1"), (27, 8, F.date_format("o_orderdate", "MMdd1015")), (40, 1, F.lit("7")), (42, 1, F.lit("3")),
             (43, 224, win), (267, 336, place), (603, 324, bracket), (927, 11, digits(okey(), 11)), (938, 11, F.lit("0" * 11))]
    return as_feed(t.read("orders"), "O1", record(962, parts), okey())


@query(
    "fixed_width_win_place",
    """
    SELECT k AS seq, race_id, 1 + k % 4 AS data_kbn, i + 1 AS horse_no,
           CASE WHEN i < 5 + k % 10 AND (k + i) % 7 > 0 THEN 11 + (k * 3 + i) % 900 END AS win_odds_x10,
           CASE WHEN i < 5 + k % 10 THEN nullif((k + i) % 15, 0) END AS win_popularity,
           10 + (k + i) % 50 AS min_odds_x10, CASE WHEN (k + i) % 5 > 0 THEN 20 + (k + i) % 60 END AS max_odds_x10,
           i < 5 + k % 10 AS has_win_block, TRUE AS has_place_block, nullif(k, 0) AS win_pool_total_100yen,
           month(o_orderdate) * 1000000 + day(o_orderdate) * 10000 + 1015 AS announce
    FROM keyed, range(28) r(i) WHERE i < 6 + k % 10
    """,
    ["keyed"],
)
def fixed_width_win_place(t: Tables) -> DataFrame:
    return extract.win_place_odds(win_odds_feed(t)).select(
        "seq", "race_id", "data_kbn", "horse_no", "win_odds_x10", "win_popularity", "min_odds_x10", "max_odds_x10",
        "has_win_block", "has_place_block", "win_pool_total_100yen", F.col("announce_mmddhhmi").cast("bigint").alias("announce"),
    )


@query(
    "fixed_width_odds_rows",
    """
    SELECT race_id, 1 AS bet_type, CAST(i + 1 AS VARCHAR) AS selection,
           CASE WHEN (k + i) % 7 > 0 THEN (11 + (k * 3 + i) % 900) / 10.0 ELSE 0 END AS odds_1, NULL AS odds_2, (k + i) % 15 AS popularity
    FROM keyed, range(28) r(i) WHERE i < 5 + k % 10
    UNION ALL SELECT race_id, 2, CAST(i + 1 AS VARCHAR), (10 + (k + i) % 50) / 10.0,
           CASE WHEN (k + i) % 5 > 0 THEN (20 + (k + i) % 60) / 10.0 END, 0
    FROM keyed, range(28) r(i) WHERE i < 6 + k % 10
    UNION ALL SELECT race_id, 3, CAST(11 + i AS VARCHAR), (30 + (k + i) % 9000) / 10.0, NULL, i + 1 FROM keyed, range(3) r(i)
    """,
    ["keyed"],
)
def fixed_width_odds_rows(t: Tables) -> DataFrame:
    return extract.odds(win_odds_feed(t)).drop("seq")


@query(
    "fixed_width_wide_odds",
    """
    SELECT k AS seq, race_id, lpad(CAST(1 + i % 17 AS VARCHAR), 2, '0') || lpad(CAST(2 + i % 16 AS VARCHAR), 2, '0') AS kumiban,
           CASE WHEN (k + i) % 6 > 0 THEN 10 + (k + i) % 999 END AS min_odds_x10, 20 + (k + i) % 999 AS max_odds_x10,
           nullif((k + i) % 150, 0) AS popularity, nullif(k % 19, 0) AS starters, 7 AS sale_flag_wide, nullif(k, 0) AS wide_pool_total_100yen
    FROM keyed, range(153) r(i) WHERE i < k % 20
    """,
    ["keyed"],
)
def fixed_width_wide_odds(t: Tables) -> DataFrame:
    wide = repeat(153, lambda i: F.when(i < okey() % 20, F.concat(
        digits(1 + i % 17, 2), digits(2 + i % 16, 2), F.when((okey() + i) % 6 == 0, "*****").otherwise(digits(10 + (okey() + i) % 999, 5)),
        digits(20 + (okey() + i) % 999, 5), digits((okey() + i) % 150, 3))).otherwise("0" * 17))
    parts = [*header("O3"), (27, 8, F.lit("01011200")), (37, 2, digits(okey() % 19, 2)), (39, 1, F.lit("7")), (40, 2601, wide), (2641, 11, digits(okey(), 11))]
    rows = extract.wide_odds(as_feed(t.read("orders"), "O3", record(2654, parts), okey()))
    return rows.select("seq", "race_id", "kumiban", "min_odds_x10", "max_odds_x10", "popularity", "starters", "sale_flag_wide", "wide_pool_total_100yen")


@query(
    "fixed_width_forecasts",
    """
    SELECT k AS seq, race_id, horse_no, dm, CASE WHEN dm IS NOT NULL THEN rank() OVER (PARTITION BY k ORDER BY dm NULLS LAST, horse_no) END AS dm_rank,
           tm, CASE WHEN tm IS NOT NULL THEN rank() OVER (PARTITION BY k ORDER BY tm DESC NULLS LAST, horse_no) END AS tm_rank
    FROM (SELECT *, i + 1 AS horse_no, CASE WHEN (k + i) % 6 > 0 THEN 600 + (k + i) % 60 * 10 + i % 10 END AS dm,
                 CASE WHEN (k + i) % 4 > 0 THEN (k * 7 + i) % 1000 END AS tm FROM keyed, range(18) r(i) WHERE i < 3 + k % 10)
    """,
    ["keyed"],
)
def fixed_width_forecasts(t: Tables) -> DataFrame:
    size = 3 + okey() % 10
    times = repeat(18, lambda i: F.when(i < size, F.concat(
        digits(i + 1, 2), F.when((okey() + i) % 6 == 0, "99999").otherwise(F.concat(F.lit("1"), digits((okey() + i) % 60, 2), digits(i % 10, 1), F.lit("7"))),
        F.lit("00500050"))).otherwise(" " * 15))
    scores = repeat(18, lambda i: F.when(i < size, F.concat(
        digits(i + 1, 2), F.when((okey() + i) % 4 == 0, "--  ").otherwise(digits((okey() * 7 + i) % 1000, 4)))).otherwise("000000"))
    orders = t.read("orders")
    time = as_feed(orders, "DM", record(303, [*header("DM"), (27, 4, F.lit("0930")), (31, 270, times)]), okey())
    score = as_feed(orders, "TM", record(141, [*header("TM"), (27, 4, F.lit("0930")), (31, 108, scores)]), okey())
    left = extract.time_forecast(time).select("seq", "race_id", "horse_no", F.col("dm_time_x10").alias("dm"), "dm_rank")
    right = extract.score_forecast(score).select("seq", "horse_no", F.col("tm_score").alias("tm"), "tm_rank")
    return left.join(right, ["seq", "horse_no"])


@query(
    "fixed_width_body_weight",
    """
    SELECT race_id, i + 1 AS horse_no, CASE WHEN (k + i) % 3 > 0 THEN 430 + (k + i) % 90 END AS body_weight_kg,
           CASE (k + i) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END AS diff_sign,
           nullif((k + i) % 20, 0) AS diff_kg
    FROM keyed, range(18) r(i) WHERE i < 3 + k % 10
    """,
    ["keyed"],
)
def fixed_width_body_weight(t: Tables) -> DataFrame:
    items = repeat(18, lambda i: F.when(i < 3 + okey() % 10, F.concat(
        digits(i + 1, 2), F.lit(" " * 36), F.when((okey() + i) % 3 == 0, "999").otherwise(digits(430 + (okey() + i) % 90, 3)),
        F.when((okey() + i) % 3 == 0, "+").when((okey() + i) % 3 == 1, "-").otherwise(" "), digits((okey() + i) % 20, 3))).otherwise(" " * 45))
    feed = as_feed(t.read("orders"), "WH", record(847, [*header("WH"), (27, 8, F.lit("01011200")), (35, 810, items)]), okey())
    return extract.body_weight(feed).drop("seq", "data_kbn", "announce_mmddhhmi")


@query(
    "fixed_width_workouts",
    """
    SELECT 'HC' AS kind, k AS seq, CAST(k AS VARCHAR) AS horse_id, CAST(o_orderdate AS DATE) AS training_date,
           CASE WHEN k % 800 > 0 THEN k % 800 / 10.0 END AS total_4f, CASE WHEN k % 150 > 0 THEN k % 150 / 10.0 END AS lap_1f FROM orders o, keyed USING (o_orderkey)
    """.replace("FROM orders o, keyed USING (o_orderkey)", "FROM keyed").rstrip() + """
    UNION ALL SELECT 'WC', k, CAST(k AS VARCHAR), CAST(o_orderdate AS DATE), CASE WHEN k % 700 > 0 THEN k % 700 / 10.0 END,
           CASE WHEN k % 150 > 0 THEN k % 150 / 10.0 END FROM keyed
    """,
    ["keyed"],
)
def fixed_width_workouts(t: Tables) -> DataFrame:
    orders = t.read("orders")
    start = [(2, 1, F.lit("1")), (11, 1, F.lit("0")), (12, 8, F.date_format("o_orderdate", "yyyyMMdd")), (20, 4, F.lit("0700")), (24, 10, okey().cast("string"))]
    slope = record(60, [(0, 2, F.lit("HC")), *start, (34, 4, digits(okey() % 800, 4)), (55, 3, digits(okey() % 150, 3))])
    wood = record(105, [(0, 2, F.lit("WC")), *start, (34, 2, F.lit("21")), (79, 4, digits(okey() % 700, 4)), (100, 3, digits(okey() % 150, 3))])
    columns = ["seq", "horse_id", "training_date", "total_4f", "lap_1f"]
    left = extract.slope_workout(as_feed(orders, "HC", slope, okey())).select(F.lit("HC").alias("kind"), *columns)
    right = extract.wood_workout(as_feed(orders, "WC", wood, okey())).select(F.lit("WC").alias("kind"), *columns)
    return left.unionByName(right)


@query(
    "fixed_width_masters",
    """
    SELECT 'jockey' AS kind, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier
    UNION ALL SELECT 'trainer', CAST(s_suppkey AS VARCHAR), s_name FROM supplier
    UNION ALL SELECT 'horse', CAST(p_partkey AS VARCHAR), p_name FROM part
    UNION ALL SELECT 'exclusion', CAST(o_orderkey AS VARCHAR), CAST(o_orderdate AS DATE) || ' ' || (1 + o_custkey % 12) FROM orders
    """,
)
def fixed_width_masters(t: Tables) -> DataFrame:
    supplier = t.read("supplier")
    number, name = digits(F.col("s_suppkey"), 5), F.col("s_name")
    person = record(80, [(11, 5, number), (41, 34, name)])
    jockeys = extract.jockey(as_feed(supplier, "KS", person, F.col("s_suppkey")))
    trainers = extract.trainer(as_feed(supplier, "CH", person, F.col("s_suppkey")))
    animal = record(100, [(2, 1, F.lit("1")), (10, 10, F.col("p_partkey").cast("string")), (20, 36, F.col("p_name"))])
    horses = extract.horse(as_feed(t.read("part"), "UM", animal, F.col("p_partkey")))
    out = record(60, [(2, 1, F.lit("2")), (11, 8, F.date_format("o_orderdate", "yyyyMMdd")), (19, 2, digits(1 + cust() % 12, 2)), (25, 2, F.lit("11")),
                      (27, 10, okey().cast("string")), (37, 18, F.lit("　ななし")), (55, 5, F.lit("00110"))])
    gone = extract.exclusion(as_feed(t.read("orders"), "JG", out, okey())).filter("horse_name = 'ななし' and flags = '00110'")
    row = lambda df, kind, key, name: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("id"), name.alias("name"))
    parts = [
        row(jockeys, "jockey", F.col("jockey_id"), F.col("jockey_name")),
        row(trainers, "trainer", F.col("trainer_id"), F.col("trainer_name")),
        row(horses, "horse", F.col("horse_id"), F.col("horse_name")),
        row(gone, "exclusion", F.col("horse_id"), F.concat_ws(" ", F.col("race_date").cast("string"), "track_code")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "fixed_width_stats",
    """
    SELECT c_custkey AS seq, CAST(c_custkey AS VARCHAR) AS horse_id,
           [CAST((c_custkey + i) % 300 AS INT) FOR i IN range(6)] AS overall, [CAST((c_custkey * 2 + i) % 90 AS INT) FOR i IN range(6)] AS dirt_2801_up,
           c_custkey % 40 AS sashi, c_custkey * 10 + 7 AS jockey_cum_flat, c_custkey + 5 AS owner_year_total
    FROM customer
    """,
)
def fixed_width_stats(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    parts = [
        (0, 3, F.lit("CK1")), (3, 8, F.lit("20240101")), (11, 16, F.lit("2024010105010203")), (27, 10, c.cast("string")),
        (127, 18, repeat(6, lambda i: digits((c + i) % 300, 3))), (811, 18, repeat(6, lambda i: digits((c * 2 + i) % 90, 3))),
        (1375, 3, digits(c % 40, 3)), (1423 + 1220 + 4, 10, digits(c * 10, 10)), (1423 + 1220 + 24, 10, digits(F.lit(7), 10)),
        (6480, 10, digits(c, 10)), (6490, 10, digits(F.lit(5), 10)),
    ]
    out = extract.horse_stats(as_feed(t.read("customer"), "CK", record(6870, parts), c))
    return out.select(
        "seq", "horse_id", "finish_counts.overall", "finish_counts.dirt_2801_up", "style_counts.sashi",
        F.col("entity_prize.jockey.cum_flat").alias("jockey_cum_flat"), F.col("entity_prize.owner.year_total").alias("owner_year_total"),
    )


@query(
    "fixed_width_changes",
    """
    SELECT CASE k % 5 WHEN 0 THEN 'WE' WHEN 1 THEN 'AV' WHEN 2 THEN 'JC' WHEN 3 THEN 'TC' ELSE 'CC' END AS record_type,
           CASE WHEN k % 5 = 0 THEN race_id - (1 + k % 12) ELSE race_id END AS race_id, k AS seq,
           CASE k % 5 WHEN 0 THEN CAST(k % 9 AS VARCHAR) WHEN 1 THEN CAST(1 + k % 18 AS VARCHAR) WHEN 2 THEN 'J' || k % 1000
                WHEN 3 THEN lpad(CAST(900 + k % 60 AS VARCHAR), 4, '0') ELSE CAST((10 + k % 20) * 100 AS VARCHAR) END AS detail
    FROM keyed
    """,
    ["keyed"],
)
def fixed_width_changes(t: Tables) -> DataFrame:
    key = [(2, 1, F.lit("1")), (3, 8, F.lit("20240101")), (11, 16, race_key()), (27, 8, F.lit("01011200"))]
    meeting = [(2, 1, F.lit("1")), (11, 14, F.substring(race_key(), 1, 14)), (25, 8, F.lit("01011200")), (34, 1, digits(okey() % 9, 1))]
    kinds = {
        "WE": (42, meeting), "AV": (78, [*key, (35, 2, digits(1 + okey() % 18, 2))]),
        "JC": (161, [*key, (76, 5, F.concat(F.lit("J"), (okey() % 1000).cast("string")))]),
        "TC": (45, [*key, (35, 4, digits(900 + okey() % 60, 4))]), "CC": (50, [*key, (35, 4, digits(10 + okey() % 20, 4))]),
    }
    feed = None
    for i, (kind, (width, parts)) in enumerate(kinds.items()):
        rows = t.read("orders").filter(okey() % 5 == i)
        part = as_feed(rows, kind, record(width, [(0, 2, F.lit(kind)), *parts]), okey())
        feed = part if feed is None else feed.unionByName(part)
    out = extract.changes(feed)
    names = F.array(*[F.lit(n) for n in ("weather_now", "horse_no", "jockey_code_after", "post_time_after", "distance_m_after")])
    kind_no = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("record_type")).cast("int")
    return out.select("record_type", "race_id", "seq", F.try_element_at("detail", F.element_at(names, kind_no)).alias("detail"))


# --- feed files --------------------------------------------------------------

LINES_PER_FILE = 200_000
_FEEDS: dict[tuple[str, str], str] = {}


def _write_lines(lines: DataFrame, folder: str, kind: str) -> None:
    """Lines as gzipped files `<kind>_<n>.jsonl.gz` of at most LINES_PER_FILE lines, as one file is read by one task."""
    spark, part = lines.sparkSession, f"{folder}/_{kind}"
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE).text(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(f.getPath().getName() for f in files.listStatus(path(part)) if f.getPath().getName().startswith("part-"))
    for n, name in enumerate(found):
        if not files.rename(path(f"{part}/{name}"), path(f"{folder}/{kind}_{n}.jsonl.gz")):
            raise OSError(f"can't name {name}")
    files.delete(path(part), True)


def feed_folder(t: Tables) -> str:
    """A feed of the orders as files: race records with unreadable lines among them, odds, and a kind that isn't read."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _FEEDS:
        folder = shared_folder(t.spark)
        line = F.to_json(F.struct("rec_id", "payload"))
        races, odds = race_feed(t), win_odds_feed(t)
        broken = races.filter(F.col("seq") % 50 == 0).select(F.lit('{"rec_id": "RA", ').alias("value"))
        _write_lines(races.select(line.alias("value")).unionByName(broken), folder, "RACE")
        _write_lines(odds.select(line.alias("value")), folder, "0B41")
        _write_lines(odds.select(line.alias("value")), folder, "OTHER")
        _FEEDS[key] = folder
    return _FEEDS[key]


@query(
    "feed_files",
    """
    SELECT 'RACE' AS dataspec, 'RA' AS rec_id, count(*) AS records FROM orders
    UNION ALL SELECT 'RACE', NULL, count(*) FROM orders WHERE o_orderkey % 50 = 0
    UNION ALL SELECT '0B41', 'O1', count(*) FROM orders
    """,
)
def feed_files(t: Tables) -> DataFrame:
    """Lines of the files that are read, by kind and record type."""
    lines = feed.read_feed(t.spark, feed.input_paths(t.spark, feed_folder(t)))
    return feed.record_counts(lines).groupBy("dataspec", "rec_id").agg(F.sum("records").alias("records"))


@query(
    "feed_quarantine",
    "SELECT 'unreadable line' AS reason, count(*) AS lines FROM orders WHERE o_orderkey % 50 = 0 HAVING count(*) > 0",
)
def feed_quarantine(t: Tables) -> DataFrame:
    lines = feed.read_feed(t.spark, feed.input_paths(t.spark, feed_folder(t)))
    return feed.error_counts(feed.quarantine(lines)).groupBy("reason").agg(F.sum("lines").alias("lines"))


@query(
    "feed_rebuild",
    """
    WITH scope AS (SELECT * FROM keyed WHERE 1 + c % 12 <= 10 AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01')
    SELECT 'race' AS name, year(o_orderdate) AS year, count(DISTINCT race_id) AS rows FROM scope GROUP BY ALL
    UNION ALL
    SELECT 'o1_header', year, count(*) FROM (SELECT DISTINCT year(o_orderdate) AS year, race_id, 1 + k % 4 AS kbn FROM scope) GROUP BY year
    UNION ALL
    SELECT 'o1_win', year, count(*) FROM (SELECT DISTINCT year(o_orderdate) AS year, race_id, 1 + k % 4 AS kbn, i
                                          FROM scope, range(28) r(i) WHERE i < 5 + k % 10) GROUP BY year
    """,
    ["keyed"],
)
def feed_rebuild(t: Tables) -> DataFrame:
    """Files to tables in one scan: rows of the rebuilt tables by year."""
    built, _ = rebuild.rebuild_files(t.spark, feed_folder(t), shared_folder(t.spark), "1996-01-01")
    year = F.floor(F.col("race_id") / 100_000_000).cast("int")  # the id starts with the date
    parts = [
        built[name].groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(name))
        for name in ("race", "o1_header", "o1_win")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
