"""Registry of runnable queries, and the mapping of the test tables to the data model.

Each query is a function of `Tables`; beside it stands the SQL that gives the
same answer. `CTES` holds the SQL form of the mapping; a query names the ones it
needs with `uses`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfspark.operators import skew
from turfspark.session import stored

Query = Callable[["Tables"], DataFrame]
_RUNNERS: dict[tuple[str, str], DataFrame] = {}
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)

# name -> (body, names it reads)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "race": (
        """
        SELECT o_orderkey AS race_id, CAST(o_orderdate AS DATE) AS race_date,
               o_orderkey % 480 AS post_minute,
               1 + o_custkey % 10 AS track_code, 1 + o_orderkey % 99 AS race_no,
               1 + o_custkey % 2 AS surface, 1000 + 100 * (o_custkey % 12) AS distance_m,
               nullif(o_custkey % 5, 0) AS going, o_custkey % 3 AS weather,
               nullif(o_custkey % 7, 0) AS grade_code,
               11 + o_orderkey % 4 AS race_type_code, 1 + o_custkey % 4 AS weight_type_code,
               CASE o_custkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 16 WHEN 2 THEN 999 ELSE 701 END
                   AS condition_code_min_age,
               nullif(o_custkey % 3, 0) AS condition_code_3yo,
               nullif(o_custkey % 2, 0) AS condition_code_4yo,
               datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day_no,
               datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 1440
                   + o_orderkey % 480 AS post_at
        FROM orders
        """,
        (),
    ),
    "numbered": (
        f"""
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)})
               AS horse_no
        FROM lineitem
        """,
        (),
    ),
    "runner": (
        """
        SELECT l_orderkey AS race_id, horse_no, l_partkey AS part, l_suppkey AS supp,
               CAST(1990 + l_partkey % 8 AS VARCHAR) || lpad(CAST(l_partkey AS VARCHAR), 6, '0')
                   AS horse_id,
               l_suppkey AS jockey_id, l_suppkey % 37 AS trainer_id,
               l_quantity AS carried_weight,
               CAST(floor(l_extendedprice / 10) AS BIGINT) AS time_c,
               CASE WHEN l_linenumber < 7 THEN CAST(floor(l_extendedprice / 37) AS BIGINT) END
                   AS final3f_c,
               CAST(round(l_discount * 1000 - l_tax * 500 + l_quantity * 2) AS BIGINT) AS score_c,
               l_extendedprice AS price,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, horse_no)
                   AS finish_pos
        FROM numbered
        """,
        ("numbered",),
    ),
    "scored": (
        """
        SELECT *, score_c / 100.0 AS score, round(1 / (1 + exp(2 - score_c / 100.0)), 6) AS p,
               CASE WHEN finish_pos <= 3 THEN 1 ELSE 0 END AS y,
               CASE WHEN finish_pos = 1 THEN 1 ELSE 0 END AS y_win,
               count(*) OVER (PARTITION BY race_id) AS field_size
        FROM runner
        """,
        ("runner",),
    ),
    "history": (
        """
        SELECT r.*, q.horse_no, q.part, q.horse_id, q.jockey_id, q.trainer_id, q.carried_weight,
               q.time_c, q.final3f_c, q.finish_pos, q.time_c / 100.0 AS time_sec,
               q.final3f_c / 100.0 AS final3f_sec,
               CASE WHEN q.finish_pos <= 3 THEN 1 ELSE 0 END AS is_top3,
               CASE q.finish_pos WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS target_label,
               CASE WHEN going <= 2 THEN 1 WHEN going > 2 THEN 2 END AS going_bucket
        FROM race r JOIN runner q ON r.race_id = q.race_id
        """,
        ("race", "runner"),
    ),
    "pair": (
        """
        SELECT a.race_id, a.horse_no AS horse_no_1, b.horse_no AS horse_no_2,
               lpad(CAST(a.horse_no AS VARCHAR), 2, '0') || lpad(CAST(b.horse_no AS VARCHAR), 2, '0')
                   AS kumiban,
               a.part AS part_1, b.part AS part_2, a.p AS p_1, b.p AS p_2,
               round(a.p * b.p, 6) AS p_wide,
               CASE WHEN a.finish_pos <= 3 AND b.finish_pos <= 3 THEN 1 ELSE 0 END AS y_wide
        FROM scored a JOIN scored b ON a.race_id = b.race_id AND a.horse_no < b.horse_no
        """,
        ("scored",),
    ),
}


def cte(name: str, body: str, *uses: str) -> None:
    CTES[name] = (body, uses)


def with_ctes(uses: Sequence[str], sql: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][1]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in uses:
        visit(name)
    head = ", ".join(f"{name} AS ({CTES[name][0]})" for name in order)
    own = sql.lstrip()
    if head and own.upper().startswith("WITH "):  # the query's own expressions follow
        return f"WITH {head}, {own[5:]}"
    return f"WITH {head} {sql}" if head else sql


def query(name: str, sql: str | None = None, uses: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query; without `sql` only its rows are checked."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = with_ctes(uses, sql)
        return function

    return register


class Tables:
    """The test tables of one folder, as they are and mapped to the data model."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def race(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        day = F.col("o_orderdate").cast("date")
        condition = F.when(cust % 4 == 0, 10).when(cust % 4 == 1, 16).when(cust % 4 == 2, 999)
        return self.read("orders").select(
            key.alias("race_id"),
            day.alias("race_date"),
            (key % 480).alias("post_minute"),
            F.format_string("%02d:%02d", F.floor(key % 480 / 60), key % 60).alias("start_time"),
            (1 + cust % 10).alias("track_code"),
            (1 + key % 99).alias("race_no"),
            (1 + cust % 2).alias("surface"),
            (1000 + 100 * (cust % 12)).alias("distance_m"),
            F.nullif(cust % 5, F.lit(0)).alias("going"),
            (cust % 3).alias("weather"),
            F.nullif(cust % 7, F.lit(0)).alias("grade_code"),
            (11 + key % 4).alias("race_type_code"),
            (1 + cust % 4).alias("weight_type_code"),
            condition.otherwise(701).alias("condition_code_min_age"),
            F.nullif(cust % 3, F.lit(0)).alias("condition_code_3yo"),
            F.nullif(cust % 2, F.lit(0)).alias("condition_code_4yo"),
        )

    @cached_property
    def runner(self) -> DataFrame:
        """Runner table: numbered once per session and folder, then read like any stored table."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _RUNNERS:
            _RUNNERS[key] = stored(self._numbered_runners())
        return _RUNNERS[key]

    def _numbered_runners(self) -> DataFrame:
        first = F.col("l_linenumber").cast("double") * 1e12 + F.col("l_partkey")
        numbered = skew.number_rows(
            self.read("lineitem"), ["l_orderkey"], [F.col(c) for c in LINE_ORDER], first, "horse_no"
        )
        price = F.col("l_extendedprice")
        placed = skew.number_rows(
            numbered, ["l_orderkey"], [price.desc(), F.col("horse_no")], -price, "finish_pos", nulls_last=True
        )
        birth = (1990 + F.col("l_partkey") % 8).cast("string")
        return placed.select(
            F.col("l_orderkey").alias("race_id"),
            "horse_no",
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supp"),
            F.concat(birth, F.lpad(F.col("l_partkey").cast("string"), 6, "0")).alias("horse_id"),
            F.col("l_suppkey").alias("jockey_id"),
            (F.col("l_suppkey") % 37).alias("trainer_id"),
            F.col("l_quantity").alias("carried_weight"),
            F.floor(price / 10).alias("time_c"),
            F.when(F.col("l_linenumber") < 7, F.floor(price / 37)).alias("final3f_c"),
            F.round(F.col("l_discount") * 1000 - F.col("l_tax") * 500 + F.col("l_quantity") * 2)
            .cast("bigint")
            .alias("score_c"),
            price.alias("price"),
            "finish_pos",
        )

    @cached_property
    def _scores(self) -> DataFrame:
        score = F.col("score_c") / 100.0
        return self.runner.withColumns(
            {
                "score": score,
                "p": F.round(1 / (1 + F.exp(2 - score)), 6),
                "y": (F.col("finish_pos") <= 3).cast("int"),
                "y_win": (F.col("finish_pos") == 1).cast("int"),
            }
        )

    @cached_property
    def scored(self) -> DataFrame:
        return skew.attach_group(self._scores, ["race_id"], field_size=F.count(F.lit(1)))

    @cached_property
    def history(self) -> DataFrame:
        """Race and runner together, with the columns the history features read."""
        finish = F.col("finish_pos")
        rows = self.race.join(self.runner, "race_id")
        day = F.unix_date("race_date").cast("bigint")
        return rows.withColumns(
            {
                "race_datetime": F.col("race_date").cast("timestamp_ntz")
                + F.make_dt_interval(mins=F.col("post_minute")),
                "time_sec": F.col("time_c") / 100.0,
                "final3f_sec": F.col("final3f_c") / 100.0,
                "is_top3": (finish <= 3).cast("int"),
                "target_label": F.when(finish == 1, 3).when(finish == 2, 2).when(finish == 3, 1).otherwise(0),
                "jockey_key": F.col("jockey_id"),
                "trainer_key": F.col("trainer_id"),
                "going_bucket": F.when(F.col("going") <= 2, 1.0).when(F.col("going") > 2, 2.0),
                "day_no": day,
            }
        )

    @cached_property
    def pair(self) -> DataFrame:
        from turfspark.operators import ranking

        joined = ranking.pairs(self._scores, ["part", "p", "finish_pos"])  # the size of the field isn't asked for
        both = (F.col("finish_pos_1") <= 3) & (F.col("finish_pos_2") <= 3)
        return joined.withColumns(
            {"p_wide": F.round(F.col("p_1") * F.col("p_2"), 6), "y_wide": both.cast("int")}
        ).drop("finish_pos_1", "finish_pos_2")
