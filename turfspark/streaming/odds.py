"""Odds feed as a stream: a current snapshot table and as-of selections that are kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turfspark.operators import merge


BUCKETS = 64


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def _current(spark: SparkSession, target: str, version: int) -> dict[int, int]:
    """Which version holds each bucket of the table, at most BUCKETS entries."""
    if version < 0:
        return {}
    listed = spark.read.schema("bucket int, v long").parquet(f"{target}/manifest/v={version}")
    return {r.bucket: r.v for r in listed.collect()}


def current_snapshot(
    stream: DataFrame,
    target: str,
    keys: Sequence[str],
    checkpoint: str,
    *,
    deleted: str = "is_deleted",
) -> StreamingQuery:
    """Keep the last record per key in a table of Parquet folders under `target`.

    Each micro-batch merges with the buckets of keys that it touches, as the
    batch path does: the record with the highest place in the feed wins, however
    late it comes, so repeated deliveries change nothing. Only touched buckets
    are written again, under the batch id, and a manifest says where each bucket
    is now; a batch that runs again writes the same folders. Deletions stay in
    the table (marked) so that late, older records do not bring a key back.
    """
    state = list(stream.columns)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(*state).withColumn("bucket", _bucket(keys)).persist()
        before = _current(spark, target, batch_id - 1)
        touched = {r.bucket for r in fresh.select("bucket").distinct().collect()}
        rows, schema = fresh, fresh.schema
        for bucket in sorted(touched & set(before)):
            old = spark.read.schema(schema).parquet(f"{target}/v={before[bucket]}/part={bucket}")
            rows = rows.unionByName(old)
        newest = F.max_by(F.struct(*rows.columns), F.col(merge.SEQ))
        merged = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(newest.alias("_r")).select("_r.*")
        merged.withColumn("part", F.col("bucket")).write.mode("overwrite").partitionBy("part").parquet(f"{target}/v={batch_id}")
        fresh.unpersist()
        now = [(k, v) for k, v in before.items() if k not in touched] + [(k, batch_id) for k in touched]
        spark.createDataFrame(now, "bucket int, v long").coalesce(1).write.mode("overwrite").parquet(
            f"{target}/manifest/v={batch_id}"
        )

    return (
        stream.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_snapshot(spark: SparkSession, target: str, version: int, *, deleted: str = "is_deleted") -> DataFrame:
    """A version of the table without its deleted keys."""
    paths = [f"{target}/v={v}/part={bucket}" for bucket, v in sorted(_current(spark, target, version).items())]
    return spark.read.parquet(*paths).filter(~F.col(deleted)).drop(deleted, "bucket")


def asof_stream(
    stream: DataFrame,
    minutes: int,
    values: Sequence[str],
    *,
    keys: Sequence[str] = ("race_id", "horse_no"),
    delay: str = "1 hour",
) -> DataFrame:
    """Newest announcement no later than post time minus `minutes`, per runner, as a streaming aggregate.

    Post time is part of the key and carries the watermark: the state of a race
    is dropped once its post time is safely past. Emit with update or append mode.
    """
    cut = F.col("race_ts") - F.make_dt_interval(mins=F.lit(minutes))
    usable = F.col("announce_ts") <= cut
    for value in values:
        usable = usable & (F.col(value) > 0)
    chosen = F.max_by(F.struct(*values, "data_kbn"), F.struct("announce_ts", "data_kbn"))
    return (
        stream.withWatermark("race_ts", delay)
        .filter(usable)
        .groupBy(*keys, "race_ts")
        .agg(chosen.alias("_v"))
        .select(*keys, "race_ts", *[F.col("_v")[v].alias(v) for v in values], F.col("_v.data_kbn").alias("data_kbn"))
    )


def write_updates(chosen: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write what each micro-batch changed under its batch id; only open groups are kept as state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        chosen.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_updates(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = spark.read.parquet(target)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), F.col("batch"))
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")
