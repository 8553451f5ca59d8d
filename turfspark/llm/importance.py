"""Quality by importance resampling.

Two generative models over hashed words and word pairs, one of target text and one of all raw text,
give each document a log ratio. Gumbel noise is added, and the k largest are a sample without
replacement in proportion to the ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfspark.llm import common
from turfspark.llm import words as W

BUCKETS = 1 << 16
TARGET_TEXTS = 20_000  # bound of the labelled sample that the target model is fitted on
SMOOTHING = 1.0
BINS = 2048


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, then of the word pairs, of all texts; and the text each belongs to."""
    found, counts = W.word_hashes(data, offsets)
    pairs, n_pairs = W.grams(found, counts, 2)
    texts = np.arange(len(counts))
    owner = np.concatenate([np.repeat(texts, counts), np.repeat(texts, n_pairs)])
    return (np.concatenate([found, pairs]) % np.uint64(BUCKETS)).astype(np.int64), owner


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features by bucket, one set of rows per partition."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for batch in batches:
        data, offsets = W.utf8(batch.column("text"))
        chosen = np.array(batch.column("target").to_pylist(), dtype=bool)
        for a, b in W.slices(offsets):
            buckets, owner = _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            raw += np.bincount(buckets, minlength=BUCKETS)
            target += np.bincount(buckets[chosen[a:b][owner]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"]
    )


def _score(ratio: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            found = [np.zeros(0)]
            for a, b in W.slices(offsets):
                buckets, owner = _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found.append(np.bincount(owner, weights=ratio[buckets], minlength=b - a))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.concatenate(found))], names=[*kept, "log_ratio"]
            )

    return score


def log_ratios(rows: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """Log of target by raw probability of each bucket. `target_ids` (doc_id) must be bounded.

    Raw counts are over all rows; the ids of the target sample are broadcast.
    """
    flagged = rows.select("doc_id", "text").join(
        F.broadcast(target_ids.select("doc_id").distinct().withColumn("target", F.lit(True))), "doc_id", "left"
    )
    counted = (
        flagged.select("text", F.coalesce("target", F.lit(False)).alias("target"))
        .mapInArrow(_count, "bucket long, raw double, target double")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counted["bucket"]] = counted["raw"]
    target[counted["bucket"]] = counted["target"]
    # smoothing follows the raw model, so a bucket that the sample doesn't show says little
    base = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    aim = (target + SMOOTHING * BUCKETS * base) / (target.sum() + SMOOTHING * BUCKETS)
    return np.log(aim) - np.log(base)


def nth_largest(df: DataFrame, column: str, n: int) -> tuple[float, int] | None:
    """The n-th largest value and how many are larger, by histograms that close in on it.

    Only counts per bin reach the driver. None if n is less than 1 or more than the rows.
    """
    low, high, rows = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < 1 or n > rows:
        return None
    above = 0
    while low < high:
        width = (high - low) / BINS
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        bins = (
            df.where(F.col(column).between(low, high))
            .groupBy(at.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .orderBy(F.desc("low"))
            .collect()
        )
        for b in bins:
            if above + b.n >= n:
                low, high = b.low, b.high
                break
            above += b.n
        if len(bins) == 1:  # the values are too close for the bins
            values = df.where(F.col(column).between(low, high)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            for v in values.orderBy(F.desc(column)).toLocalIterator():
                if above + v.n >= n:
                    return v[column], above
                above += v.n
    return low, above


def gumbel(doc_id: Column, text: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on id, text and seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text)), 11)
    return -F.log(-F.log((bits + 0.5) / float(1 << 53)))


def target_sample(labels: DataFrame, bound: int = TARGET_TEXTS) -> tuple[DataFrame, float]:
    """Ids of at most `bound` documents labelled good, picked by a hash, and the share of good labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    good = known.where(F.col("quality") == 1).select("doc_id").distinct()
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), 1.0 if share is None else share


def resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    share: float | None = None,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, log_ratio, key, selected of every row.

    `share` of the rows is selected (by default the share of good labels among all labels), those with
    the largest keys; of equal keys, which only equal rows have, the first rows. Null and empty texts have
    ratio 0. Without good labels every ratio is 0. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    chosen, good = target_sample(labels.select("doc_id", "quality"))
    ratio = log_ratios(rows, common.cut(chosen))
    noisy = rows.withColumn("noise", gumbel(F.col("doc_id"), F.coalesce("text", F.lit("")), seed))
    noisy = noisy.select("doc_id", "noise", "text")
    kind = dict(rows.dtypes)["doc_id"]
    scored = noisy.mapInArrow(_score(ratio), f"doc_id {kind}, noise double, log_ratio double")
    keyed = scored.select("doc_id", "log_ratio", (F.col("log_ratio") + F.col("noise")).alias("key"))
    keyed = common.stored(keyed.withColumn(common.ROW, F.monotonically_increasing_id()))
    wanted = round((good if share is None else share) * keyed.count())
    edge = nth_largest(keyed, "key", wanted)
    if edge is None:
        return keyed.select("doc_id", "log_ratio", "key", F.lit(wanted > 0).alias("selected"))
    value, above = edge
    tied = keyed.where(F.col("key") == value).select((-F.col(common.ROW)).cast("double").alias("at"))
    last = nth_largest(tied, "at", wanted - above)
    inside = (F.col("key") > value) | ((F.col("key") == value) & (-F.col(common.ROW) >= last[0]))
    return keyed.select("doc_id", "log_ratio", "key", inside.alias("selected"))
