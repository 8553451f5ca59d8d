"""Stored tables, row identity and connected components, shared by the operators of this folder.

Every operator starts by giving its input rows an identity of their own (`numbered`), because ids in
the data may be null or repeated. The numbers are written with the rows, so a recomputed task can't
change them. Only the named columns are taken along, under fixed names, so further columns of any
name do no harm.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turfspark.session import materialize, shared_folder

ROW = "row"
LEADERS = 4  # members of a bucket's group that the others are compared with in a round
STAR_NODES = 1 << 20  # nodes that a task joins at a time
CHEAP = 8  # pairs an entry of a bucket that hints may sort out without a round


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone already; the folder is scratch
        return


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared scratch area, removed when the driver ends."""
    folder = shared_folder(spark)
    atexit.register(_remove, spark, folder)
    return folder if "://" in folder else f"file://{folder}"


def stored(df: DataFrame) -> DataFrame:
    """Write the frame as Parquet into the shared folder and read it back: lineage ends here.

    Tasks that run again after a lost executor read the same files. zstd keeps the files small.
    """
    folder = f"{scratch(df.sparkSession)}/table"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint for narrow frames that are read more than once."""
    return materialize(df)


def numbered(df: DataFrame, **columns: str | Column) -> DataFrame:
    """The named columns and a row number of their own, stored.

    Row numbers are unique, not dense. `columns` maps the fixed names to columns of `df`.
    """
    picked = {name: F.col(f"`{c}`") if isinstance(c, str) else c for name, c in columns.items()}
    rows = df.select(*[c.alias(name) for name, c in picked.items()])
    return stored(rows.withColumn(ROW, F.monotonically_increasing_id()))


def with_payload(df: DataFrame) -> DataFrame:
    """All columns in one struct `payload` beside a stored row number; undo with `payload.*`."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("payload"))
    return stored(packed.withColumn(ROW, F.monotonically_increasing_id()))


def first_id(doc_id: str = "doc_id", row: str = ROW) -> Column:
    """Orders rows by id, null ids last, equal ids by row number."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(row).alias(row))


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a partition as links to the smallest node that the partition joins them with.

    At most about STAR_NODES nodes are held; what such parts leave apart, the rounds put together.
    """
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    def stars() -> pd.DataFrame:
        found = [(root(node), node) for node in parent if root(node) != node]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            low, high = sorted((root(u), root(v)))
            parent[high] = low
        if len(parent) >= STAR_NODES:
            yield stars()
            parent.clear()
    yield stars()


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, label), label = smallest node.

    Alternates two steps until nothing changes: every node hands the smallest node it knows to its
    larger neighbours, then to its smaller ones. Each step is an aggregate with map-side combining and
    a join by node, so a node with very many neighbours is never gathered in one place.
    Only nodes with an edge are returned; an empty graph gives no rows.
    """
    links = cut(
        edges.select(F.least(low, high).alias("u"), F.greatest(low, high).alias("v"))
        .where("u <> v")
        .distinct()
    )
    # each partition alone first: what it links becomes stars, so few rounds are left
    links = cut(links.mapInPandas(_stars, "u long, v long"))
    both = links.union(links.select(F.col("v"), F.col("u")))
    label = both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label"))
    while True:
        # hook: the smallest label among the neighbours ...
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node"))
        hooked = label.join(near.agg(F.min("label").alias("near")), "node")
        hooked = cut(hooked.select("node", "label", F.least("label", "near").alias("to")))
        # ... goes to the root of the own tree, then every node follows its root once more
        root = hooked.groupBy(F.col("label").alias("root")).agg(F.min("to").alias("best"))
        moved = hooked.join(root, hooked.label == root.root).select(
            "node", F.col("label").alias("was"), F.least("to", "best").alias("mid")
        )
        jump = root.select(F.col("root").alias("mid"), F.col("best").alias("next"))
        moved = cut(
            moved.join(jump, "mid", "left").select(
                "node", "was", F.least("mid", F.coalesce("next", "mid")).alias("label")
            )
        )
        label = moved.select("node", "label")
        if moved.where("was <> label").isEmpty():
            return label


def distinct_buckets(shared: DataFrame) -> DataFrame:
    """(band, node, ...) without the buckets of one node, and one bucket of those with the same nodes.

    Buckets are compared by how many nodes they have and two 64-bit sums of hashes.
    """
    shared = stored(shared)
    sums = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"h{seed}") for seed in (1, 2)]
    buckets = shared.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *sums).where("n > 1")
    kept = stored(buckets.groupBy("n", "h1", "h2").agg(F.min("band").alias("band")).select("band"))
    return stored(shared.join(kept, "band", "left_semi"))


def bucket_classes(
    shared: DataFrame, verified: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """Classes (node, label) of nodes that share buckets; a node that is alone may be missing.

    `shared` has band, node and, with `near`, a hint: pairs whose hints are not near are no candidates.
    `verified` returns those of the pairs (a, b) that are linked. In each round the nodes of a bucket are
    compared with one of them, another one in each of a few bands, unless they are in one class already;
    every other round it is the one with most links so far, which finds the middle of a star. Classes only grow, so a bucket of one class is done and goes. When the pairs left between classes are
    no more than the entries of the buckets, or a round links nothing, all of these are compared. Most pairs go by
    their hints alone, so with `near` CHEAP times as many are compared at once, and also any number of them that two
    rounds have not lowered by a quarter. The result is the same whenever the rounds end.
    """
    hint = ["hint"] if near is not None else []
    open_ = shared.select("band", "node", *hint, F.col("node").alias("label"))
    entries = open_.count()
    label, links, tested = None, None, None
    seed = 0
    before: list[float] = []  # pairs left at the start of each round
    while True:
        parts = open_.groupBy("band", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
        all_, same = F.sum("n"), F.sum(F.col("n") * F.col("n"))
        mixed = parts.groupBy("band").agg(F.count(F.lit(1)).alias("labels"), ((all_ * all_ - same) / 2).alias("cross"))
        mixed = stored(mixed.where("labels > 1").select("band", "cross"))
        cross = mixed.agg(F.sum("cross")).first()[0]
        if not cross:
            break
        open_ = stored(open_.join(mixed, "band", "left_semi"))
        every = cross <= (entries // 2 if near is None else CHEAP * entries) or seed < 0
        if near is not None and len(before) > 1:
            every = every or cross > 0.75 * before[-2]
        before.append(cross)

        def side(frame: DataFrame, node: str, suffix: str) -> DataFrame:
            return frame.select("band", F.col("node").alias(node), *[F.col(c).alias(c + suffix) for c in ["label", *hint]])

        if every:
            pairs = side(open_, "other", "_b").join(side(open_, "one", "_a"), "band").where("one < other and label_a <> label_b")
        else:
            pick = F.xxhash64(F.lit(seed), F.pmod(F.col("band"), F.lit(LEADERS)), "node")
            ranked = open_.withColumn("few", F.lit(0).cast("long"))
            if seed % 2:
                ends = links.select(F.col("a").alias("node")).union(links.select("b"))
                few = stored(ends.groupBy("node").agg((-F.count(F.lit(1))).alias("few")))
                ranked = open_.join(few, "node", "left").withColumn("few", F.coalesce("few", F.lit(0).cast("long")))
            best = F.min(F.struct("few", pick.alias("h"), "node", "label", *hint))
            first = ranked.groupBy("band").agg(best.alias("f"))
            first = stored(first.select("band", "f.*"))
            pairs = side(open_, "other", "_b").join(side(first, "one", "_a"), "band").where("label_a <> label_b")
        if near is not None:
            pairs = pairs.where(near(F.col("hint_a"), F.col("hint_b")))
        pairs = pairs.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        found = stored(verified(pairs))
        if found.isEmpty():
            # no progress: after a round without regard to links compare all that is left
            seed = -1 if seed % 2 == 0 else seed + 1
        else:
            seed += 1
            links = found if links is None else links.union(found)
            label = stored(components(links))
            open_ = open_.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        if every:
            break
        tested = pairs if tested is None else tested.union(pairs)
    if label is None:
        return shared.select("node", F.col("node").alias("label")).limit(0)
    return label


def packed(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Like `numbered`, with `text` as zstd bytes in `packed`: texts that are moved several times stay small.

    Null counts as empty.
    """
    picked = {name: F.col(f"`{c}`") if isinstance(c, str) else c for name, c in columns.items()}
    rows = df.select(*[c.alias(name) for name, c in picked.items()]).withColumn(ROW, F.monotonically_increasing_id())
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["packed binary"])
    return stored(rows.select(*[f.name for f in kept], "text").mapInArrow(_pack, schema))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    engine = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_binary()).fill_null(b"")
        small = [engine.compress(memoryview(t.as_buffer())) for t in texts]
        kept = batch.columns[:-1]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(small, pa.binary())], names=[*batch.schema.names[:-1], "packed"])


def unpacked(column: pa.Array) -> list[bytes]:
    """The texts of `packed` as UTF-8 bytes."""
    engine = zstandard.ZstdDecompressor()
    return [engine.decompress(memoryview(t.as_buffer())) if t.is_valid else b"" for t in column]
