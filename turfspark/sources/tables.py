"""Reading and writing of tables, features and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORE_SCHEMAS = {
    "race": (
        "race_id bigint, race_date date, track_code smallint, race_no smallint, surface smallint, "
        "distance_m smallint, going smallint, weather smallint, class_code smallint, "
        "field_size smallint, start_time string, turn_dir smallint, course_inout smallint, "
        "grade_code smallint, race_type_code smallint, weight_type_code smallint, "
        "condition_code_min_age smallint, condition_code_2yo smallint, condition_code_3yo smallint, "
        "condition_code_4yo smallint, condition_code_5up smallint, condition_code_min_age_raw smallint"
    ),
    "horse": "horse_id string, horse_name string",
    "jockey": "jockey_id bigint, jockey_name string",
    "trainer": "trainer_id bigint, trainer_name string",
    "runner": (
        "race_id bigint, horse_id string, horse_no smallint, gate smallint, jockey_id bigint, "
        "trainer_id bigint, carried_weight decimal(4,1), body_weight smallint, "
        "body_weight_diff smallint, sex smallint, data_kubun string, trainer_code_raw string, "
        "trainer_name_abbr string, jockey_code_raw string, jockey_name_abbr string"
    ),
    "result": (
        "race_id bigint, horse_id string, finish_pos smallint, time_sec decimal(6,2), margin string, "
        "final3f_sec decimal(5,2), corner1_pos smallint, corner2_pos smallint, corner3_pos smallint, "
        "corner4_pos smallint"
    ),
    "payout": (
        "race_id bigint, bet_type smallint, selection string, payout_yen int, popularity smallint"
    ),
    "o1_header": (
        "race_id bigint, data_kbn smallint, announce_mmddhhmi string, win_pool_total_100yen bigint, "
        "data_create_ymd string, sale_flag_place smallint, place_pay_key smallint, "
        "place_pool_total_100yen bigint"
    ),
    "o1_win": (
        "race_id bigint, data_kbn smallint, announce_mmddhhmi string, horse_no smallint, "
        "win_odds_x10 int, win_popularity smallint"
    ),
    "o1_place": (
        "race_id bigint, data_kbn smallint, announce_mmddhhmi string, horse_no smallint, "
        "min_odds_x10 int, max_odds_x10 int, place_popularity smallint"
    ),
    "o3_header": (
        "race_id bigint, data_kbn smallint, announce_mmddhhmi string, wide_pool_total_100yen bigint, "
        "starters smallint, sale_flag_wide smallint, data_create_ymd string"
    ),
    "o3_wide": (
        "race_id bigint, data_kbn smallint, announce_mmddhhmi string, kumiban string, "
        "min_odds_x10 int, max_odds_x10 int, popularity smallint"
    ),
    "mining_dm": "race_id bigint, horse_no smallint, data_kbn smallint, dm_time_x10 int, dm_rank smallint",
    "mining_tm": "race_id bigint, horse_no smallint, data_kbn smallint, tm_score int, tm_rank smallint",
    "rt_mining_dm": (
        "race_id bigint, horse_no smallint, data_kbn smallint, data_create_ymd string, "
        "data_create_hm string, dm_time_x10 int, dm_rank smallint"
    ),
    "rt_mining_tm": (
        "race_id bigint, horse_no smallint, data_kbn smallint, data_create_ymd string, "
        "data_create_hm string, tm_score int, tm_rank smallint"
    ),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns and types of a core table; what does not fit a type becomes null."""
    fields = StructType.fromDDL(CORE_SCHEMAS[table]).fields
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV/TXT with a header, else Parquet, by the file's suffix.

    Without a schema a CSV is read twice (types are inferred).
    """
    if path.lower().rsplit(".", 1)[-1] in ("csv", "txt"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(path)
    return spark.read.parquet(path)


def write_by_year(df: DataFrame, path: str, *, date: str = "race_date", mode: str = "overwrite") -> None:
    """Features partitioned by year and ordered by race and runner within the files.

    Rows are range-partitioned by race id: race ids grow with the date, so a
    task writes into few years, and a year takes as many tasks as it needs.
    """
    out = df if "year" in df.columns else df.withColumn("year", F.year(date))
    ordered = out.repartitionByRange("year", "race_id").sortWithinPartitions("year", "race_id", "horse_no")
    ordered.write.mode(mode).partitionBy("year").parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str, *, mode: str = "overwrite") -> None:
    for name, table in tables.items():
        conform(table, name).write.mode(mode).parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    wanted = names or list(CORE_SCHEMAS)
    return {n: spark.read.schema(CORE_SCHEMAS[n]).parquet(f"{folder}/{n}") for n in wanted}
