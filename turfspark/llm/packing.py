"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

Documents are dealt by hash into groups of about `GROUP` pieces, packed one group per task call. Within a
group, pieces come longest first; bins are kept in order of what room they have left, each with bitmaps
of its sources and duplicate clusters. The search starts at the tightest bin that has room and goes on to
the next until one has neither the source nor the cluster of the piece; if none is left, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfspark.llm import common

CAPACITY = 2048
GROUP = 4096
_PACKED = "row long, piece long, bin long, at long, length long"


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """Bin and place in it of each piece. Null sources and clusters conflict with nothing.

    Pieces are taken longest first, equal ones in the order given; of bins with equal room the older one.
    """

    def bits(values: list) -> list[int]:
        number: dict = {}
        count: dict = {}
        for v in values:
            count[v] = count.get(v, 0) + 1
        return [0 if v is None or count[v] < 2 else 1 << number.setdefault(v, len(number)) for v in values]

    source, cluster = bits(sources), bits(clusters)
    room: list[tuple[int, int]] = []  # (room left, bin) in order
    held: list[list[int]] = []  # by bin: sources, clusters
    out = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        s, c, n = source[i], cluster[i], lengths[i]
        k = bisect_left(room, (n, -1))
        while k < len(room) and (held[room[k][1]][0] & s or held[room[k][1]][1] & c):
            k += 1
        if k < len(room):
            left, bin_ = room.pop(k)
        else:
            left, bin_ = capacity, len(held)
            held.append([0, 0])
        held[bin_][0] |= s
        held[bin_][1] |= c
        out[i] = (bin_, capacity - left)
        if left > n:
            insort(room, (left - n, bin_))
    return out


def _pack(capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row", "piece"], ascending=[False, True, True])
        plain = [[None if v is None or v != v else v for v in frame[c].astype(object)] for c in ("source", "cluster")]
        placed = best_fit(frame["length"].tolist(), *plain, capacity)
        group = int(frame["pack"].iloc[0]) << 32
        return pd.DataFrame({
            "row": frame["row"].to_numpy(),
            "piece": frame["piece"].to_numpy(),
            "bin": np.array([group + b for b, _ in placed], dtype="int64"),
            "at": np.array([a for _, a in placed], dtype="int64"),
            "length": frame["length"].to_numpy(),
        })

    return pack


def token_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def exact_cluster(text: Column) -> Column:
    """Cluster of texts that are equal up to white space."""
    return F.xxhash64(F.regexp_replace(text, r"\s+", " "))


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    length: Column | None = None,
    source: str | None = "source",
    cluster: Column | None = None,
    text: str = "text",
    capacity: int = CAPACITY,
    group: int = GROUP,
) -> DataFrame:
    """doc_id, piece, n_tokens, bin, at: one row per piece of a document.

    A document longer than `capacity` is cut into pieces of that length and a rest; whole pieces fill a
    bin each. A document of length 0 (null or empty text) has one piece with null bin and at. No bin
    has two documents of one source or one cluster; a null source is no conflict. Equal lengths are
    taken in row order, so repeated rows are packed each. An empty table gives no rows.
    """
    words = token_count(F.col(f"`{text}`")) if length is None else length
    same = exact_cluster(F.col(f"`{text}`")) if cluster is None else cluster
    origin = F.lit(None).cast("long") if source is None else F.xxhash64(F.col(f"`{source}`"))
    origin = origin if source is None else F.when(F.col(f"`{source}`").isNotNull(), origin)
    rows = common.numbered(docs, doc_id=doc_id, length=words, source=origin, cluster=same)
    size = F.col("length")
    last = F.ceil(size / capacity) - 1
    cut = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)).cast("long"))).alias("piece"))
    pieces = cut.withColumn(
        "length", F.when(F.col("piece") < last, F.lit(capacity)).otherwise(size - F.col("piece") * capacity).cast("long")
    )
    part = (size > 0) & (size < capacity)
    open_, whole = pieces.where(part), pieces.where(~part)
    groups = max(1, -(-open_.count() // group))
    dealt = open_.select(
        F.pmod(F.xxhash64(common.ROW), F.lit(groups)).alias("pack"), common.ROW, "piece", "length", "source", "cluster"
    )
    packed = dealt.groupBy("pack").applyInPandas(_pack(capacity), _PACKED)
    ids = rows.select("doc_id", common.ROW)
    placed = packed.join(ids, common.ROW).select("doc_id", "piece", F.col("length").alias("n_tokens"), "bin", "at")
    # whole pieces: a bin of their own, numbered apart from the groups (from -1 down); empty documents: none
    own = F.when(size > 0, -1 - F.monotonically_increasing_id())
    alone = whole.select(
        "doc_id", "piece", size.alias("n_tokens"), own.alias("bin"), F.when(size > 0, F.lit(0).cast("long")).alias("at")
    )
    return placed.unionByName(alone)
