"""Removal of byte strings that occur in an earlier document, by a partitioned sparse suffix sort.

A string of LENGTH bytes is taken to its anchor: of the KMER-byte substrings in it, the one with the
smallest hash. Equal strings have the same anchor at the same offset, so only suffixes that begin at
anchors, about one in 14, have to be brought together:

1. Texts are put into blocks. Every block tells which anchors it has; those that only one document of the
   whole corpus has are dropped (a filter by hash, which may only keep too much).
2. Within a block, equal strings are put together first, and only the earliest one is sent on, so a
   passage that a third of the corpus has costs each block one suffix.
3. Splitters sampled from the anchors range-partition the suffixes by their leading bytes. Equal strings
   share the leading bytes of their anchor, so none straddles a boundary between buckets.
4. Each bucket sorts by multikey quicksort, eight bytes a step and only within ties, and compares what
   became neighbours. Strings that an earlier document has go back to their block as one bit each.

The longest document of a block must fit in a task, at about 60 bytes of memory per byte of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark.llm import common
from turfspark.llm import words as W

LENGTH = 50
KMER = 24
SPAN = LENGTH - KMER + 1  # anchors a string can have
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 12 << 20  # bytes of text per bucket
SAMPLE_PER_BUCKET = 64
HASH_BITS = 40
CHUNK = 1 << 18  # strings sorted at once
U64 = np.uint64
_LAST = 2**63 - 1
_BASE = 0xD6E8FEB86659FD93 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.zeros(0, dtype=U64), np.zeros(0, dtype=U64)]
_BYTES = W.mix(np.arange(1, 257, dtype=U64) * U64(0x9FB21C651E98DF25))
_BLOCKS = "block long, ids array<bigint>, sizes array<bigint>, packed binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in blocks of about BLOCK_BYTES."""
    engine, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = W.utf8(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        for a, b in W.slices(offsets, BLOCK_BYTES):
            packed = engine.compress(memoryview(np.ascontiguousarray(data[offsets[a] : offsets[b]])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([ids[a:b]], pa.list_(pa.int64())),
                    pa.array([np.diff(offsets[a : b + 1])], pa.list_(pa.int64())),
                    pa.array([packed], pa.binary()),
                ],
                names=["block", "ids", "sizes", "packed"],
            )
            number += 1


class Block:
    """Strings of a block as runs: the strings of a run start one after the other and have one anchor."""

    def __init__(self, ids: list[int | None], sizes: list[int], packed: bytes) -> None:
        self.ids = ids
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.order = np.array([_LAST if i is None else i for i in ids], dtype=np.int64)
        n = len(self.data)
        empty = np.zeros(0, dtype=np.int64)
        self.start = self.count = self.anchor = self.text = empty
        self.hash = np.zeros(0, dtype=U64)
        if n < LENGTH:
            return
        if len(_POWERS[0]) < n + 1:
            _POWERS[:] = [W.powers(_BASE, n + 1), W.powers(_BACK, n + 1)]
        self.sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(_BYTES[self.data] * _POWERS[0][:n], dtype=U64)])
        kmers = W.mix((self.sums[KMER:] - self.sums[:-KMER]) * _POWERS[1][: n - KMER + 1])
        # the smallest hash of each run of SPAN, by minima over 2, 4, 8, ...; ties: the first
        low = (kmers & ~U64(0xFFFFFFFF)) | np.arange(len(kmers), dtype=U64)
        width = 1
        while 2 * width <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < SPAN:
            low = np.minimum(low[: width - SPAN], low[SPAN - width :])
        inside = np.ones(n - LENGTH + 1, dtype=bool)
        for end in self.offsets[1:-1]:  # strings don't cross documents
            inside[max(0, end - LENGTH + 1) : end] = False
        begin = np.flatnonzero(inside)
        if not len(begin):
            return
        anchor = (low[begin] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(begin), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1)
        at = np.flatnonzero(new)
        self.start, self.anchor = begin[at], anchor[at]
        self.count = np.diff(np.append(at, len(begin)))
        self.text = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.hash = kmers[self.anchor] >> U64(64 - HASH_BITS)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes in order, and whether several documents of the block have them."""
        if not len(self.hash):
            return self.hash, np.zeros(0, dtype=bool)
        order = np.argsort(self.hash, kind="stable")
        h, text = self.hash[order], self.text[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return h[at], np.minimum.reduceat(text, at) != np.maximum.reduceat(text, at)

    def leading(self, anchor: np.ndarray) -> np.ndarray:
        """The first eight bytes at each anchor as a big-endian number."""
        taken = self.data[anchor[:, None] + np.arange(8)]
        return np.ascontiguousarray(taken).view(">u8").ravel().astype(U64)

    def candidates(self, shared: np.ndarray) -> Candidates:
        return Candidates(self, shared)


class Candidates:
    """Strings of a block whose anchor other documents have, with equal ones put together."""

    def __init__(self, block: Block, shared: np.ndarray) -> None:
        runs = np.flatnonzero(shared)
        count = block.count[runs]
        total = int(count.sum())
        begin = np.cumsum(count) - count
        self.start = np.arange(total) - np.repeat(begin, count) + np.repeat(block.start[runs], count)
        run = np.repeat(runs, count)
        order = block.order[block.text[run]]
        if total:
            value = (block.sums[self.start + LENGTH] - block.sums[self.start]) * _POWERS[1][self.start]
            place = np.lexsort((order, value))
            new = np.ones(total, dtype=bool)
            new[1:] = value[place][1:] != value[place][:-1]
            head = place[np.maximum.accumulate(np.where(new, np.arange(total), 0))]
            self.first = np.empty(total, dtype=np.int64)
            self.first[place] = head
        else:
            self.first = np.zeros(0, dtype=np.int64)
        #: an earlier document of this block has it
        self.covered = order > order[self.first]
        sent = np.flatnonzero(self.first == np.arange(total))
        new = np.ones(len(sent), dtype=bool)
        new[1:] = (sent[1:] != sent[:-1] + 1) | (run[sent[1:]] != run[sent[:-1]])
        at = np.flatnonzero(new)
        #: strings sent on, in segments of one run
        self.sent = sent
        self.segment_start = self.start[sent[at]]
        self.segment_count = np.diff(np.append(at, len(sent)))
        self.segment_anchor = block.anchor[run[sent[at]]]
        self.segment_order = order[sent[at]]

    def routed(self, block: Block, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments by bucket (stable), and the bucket of each."""
        bucket = np.searchsorted(splitters, block.leading(self.segment_anchor), side="right")
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]


def _each(batch: pa.RecordBatch) -> Iterator[tuple[dict, Block]]:
    for row in batch.to_pylist():
        yield row, Block(row["ids"], row["sizes"], row["packed"])


def _squeeze(values: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted distinct numbers as differences, and their flags."""
    steps = np.diff(values, prepend=U64(0))
    small = bool(len(steps) == 0 or steps.max() < 1 << 32)
    head = np.array([len(values), small], dtype=np.int64).tobytes()
    return head + np.packbits(flags).tobytes() + (steps.astype(np.uint32) if small else steps).tobytes()


def _stretch(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, small = np.frombuffer(data, dtype=np.int64, count=2)
    mid = 16 + -(-int(n) // 8)
    flags = np.unpackbits(np.frombuffer(data[16:mid], dtype=np.uint8), count=int(n)).astype(bool)
    steps = np.frombuffer(data[mid:], dtype=np.uint32 if small else U64).astype(U64)
    return np.cumsum(steps, dtype=U64), flags


def _cut(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of anchor hashes begins and ends in sorted values."""
    edges = np.array([-(-(k << HASH_BITS) // buckets) for k in range(buckets + 1)], dtype=U64)
    return np.searchsorted(values, edges)


def _tell(buckets: int, rate: int):
    """Anchors of each block by bucket; bucket -1 has sampled leading bytes for the splitters."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _each(batch):
                values, flags = block.anchors()
                edges = _cut(values, buckets)
                parts = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
                picked = block.anchor[W.mix(block.hash) % U64(rate) == 0] if len(block.hash) else block.anchor
                sample = block.leading(picked).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _, _ in parts] + [-1], pa.int32()),
                        pa.array([row["block"]] * (len(parts) + 1), pa.int64()),
                        pa.array([_squeeze(values[a:b], flags[a:b]) for _, a, b in parts] + [sample], pa.binary()),
                    ],
                    names=["bucket", "block", "data"],
                )

    return tell


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """For each block's anchors of a bucket: a bit that says whether another document has it."""
    parts = [_stretch(d) for d in frame["data"]]
    values = np.concatenate([v for v, _ in parts])
    flags = np.concatenate([f for _, f in parts])
    order = np.argsort(values, kind="stable")
    value = values[order]
    at = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    many = (np.diff(np.append(at, len(value))) > 1) | np.logical_or.reduceat(flags[order], at)
    out = np.empty(len(values), dtype=bool)
    out[order] = np.repeat(many, np.diff(np.append(at, len(value))))
    ends = np.cumsum([len(v) for v, _ in parts])
    bits = [np.packbits(out[e - len(v) : e]).tobytes() for e, (v, _) in zip(ends, parts, strict=True)]
    return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "bits": bits})


def _shared_runs(block: Block, replies: list[dict] | None, buckets: int) -> np.ndarray:
    values, _ = block.anchors()
    edges, known = _cut(values, buckets), np.zeros(len(values), dtype=bool)
    for reply in replies or ():
        a, b = edges[reply["bucket"]], edges[reply["bucket"] + 1]
        known[a:b] = np.unpackbits(np.frombuffer(reply["bits"], dtype=np.uint8), count=int(b - a)).astype(bool)
    return known[np.searchsorted(values, block.hash)] if len(block.hash) else np.zeros(0, dtype=bool)


def _send(buckets: int, splitters: np.ndarray):
    """Segments of each block by bucket: counts, anchor offsets, orders, then their bytes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row, block in _each(batch):
                found = block.candidates(_shared_runs(block, row["known"], buckets))
                order, bucket = found.routed(block, splitters)
                edges = np.searchsorted(bucket, np.arange(len(splitters) + 2))
                keys, blobs = [], []
                for k in range(len(splitters) + 1):
                    part = order[edges[k] : edges[k + 1]]
                    if not len(part):
                        continue
                    start, count = found.segment_start[part], found.segment_count[part]
                    size = count + LENGTH - 1
                    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
                    blob = b"".join((
                        np.array([len(part)], dtype=np.int64).tobytes(),
                        found.segment_order[part].tobytes(),
                        count.astype(np.uint8).tobytes(),
                        (found.segment_anchor[part] - start).astype(np.uint8).tobytes(),
                        block.data[at].tobytes(),
                    ))
                    keys.append(k)
                    blobs.append(engine.compress(blob))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int32()), pa.array([row["block"]] * len(keys), pa.int64()), pa.array(blobs, pa.binary())],
                        names=["bucket", "block", "data"],
                    )

    return send


def multikey(words: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: order of the rows of `words` within `groups`, and a number for equal rows.

    One word at a time, and only rows that are still tied are sorted by the next one.
    """
    order = np.argsort(groups, kind="stable")
    g = groups[order]
    new = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, dtype=bool)
    for column in range(words.shape[1]):
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        number = np.cumsum(new)[tied]
        rows = order[tied]
        value = words[rows, column]
        inner = np.lexsort((value, number))
        order[tied] = rows[inner]
        value = value[inner]
        new[tied[1:]] |= value[1:] != value[:-1]
    return order, np.cumsum(new) - 1


def _rows(data: np.ndarray, at: np.ndarray, keep: np.ndarray) -> np.ndarray:
    taken = np.where(keep, data[np.where(keep, at, 0)], 0).astype(np.uint8)
    return np.ascontiguousarray(taken).view(">u8").astype(U64)


def earlier(count: np.ndarray, anchor: np.ndarray, order: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each string of the segments: whether the same string comes with a smaller order.

    `data` holds the bytes of the segments one after the other; `anchor` is the anchor's offset.
    """
    size = count + LENGTH - 1
    begin = np.cumsum(size) - size
    right = np.arange(56)
    left = np.arange(1, 31)
    words = np.concatenate(
        [
            _rows(data, (begin + anchor)[:, None] + right, right < (size - anchor)[:, None]),
            _rows(
                np.concatenate([data, np.arange(256, dtype=np.uint8)]),
                np.concatenate([(begin + anchor)[:, None] - left, len(data) + np.stack([count, anchor], 1)], 1),
                np.concatenate([left <= anchor[:, None], np.ones((len(count), 2), dtype=bool)], 1),
            ),
        ],
        axis=1,
    )
    # suffixes from the anchors on, then what stands before them: equal rows are equal segments
    place, kind = multikey(words, np.zeros(len(count), dtype=np.int64))
    at = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    least = np.minimum.reduceat(order[place], at)
    later = np.zeros(len(count), dtype=bool)
    later[place] = order[place] > least[kind]
    out = np.repeat(later, count)
    # segments that differ but have the same anchor: compare their strings one by one
    sample = place[at]
    same = (words[sample[1:], :3] == words[sample[:-1], :3]).all(axis=1)
    family = np.cumsum(np.append(True, ~same)) - 1
    several = np.bincount(family)[family] > 1
    sample, family, least = sample[several], family[several], least[several]
    ends = np.cumsum(count[sample])
    first_out = np.cumsum(count) - count
    low = 0
    covered = np.zeros(len(count), dtype=object)
    while low < len(sample):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK, side="right"))
        high = max(high, low + 1)
        high = int(np.searchsorted(family, family[high - 1], side="right"))  # whole families
        part, n = sample[low:high], count[sample[low:high]]
        owner = np.repeat(np.arange(len(part)), n)
        shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        strings = _rows(data, (begin[part][owner] + shift)[:, None] + right, np.broadcast_to(right < LENGTH, (len(owner), 56)))
        offset = anchor[part][owner] - shift
        where, equal = multikey(strings, family[low:high][owner] * 64 + offset)
        when = least[low:high][owner]
        cut = np.flatnonzero(np.append(True, equal[1:] != equal[:-1]))
        hit = np.zeros(len(owner), dtype=bool)
        hit[where] = when[where] > np.minimum.reduceat(when[where], cut)[equal]
        for k, bits in zip(part, np.split(hit, np.cumsum(n)[:-1]), strict=True):
            covered[k] = bits
        low = high
    # every segment with the order of its kind's first one has the answers of that one
    lead = np.empty(len(count), dtype=np.int64)
    lead[place] = place[at][kind]
    for k in np.flatnonzero(~later):
        bits = covered[lead[k]]
        if isinstance(bits, np.ndarray):
            out[first_out[k] : first_out[k] + count[k]] = bits
    return out


def _sort(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket: bits for the strings that each block sent."""
    engine = zstandard.ZstdDecompressor()
    orders, counts, anchors, data, sizes = [], [], [], [], []
    for packed in frame["data"]:
        blob = engine.decompress(packed)
        n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
        orders.append(np.frombuffer(blob, dtype=np.int64, count=n, offset=8))
        counts.append(np.frombuffer(blob, dtype=np.uint8, count=n, offset=8 + 8 * n).astype(np.int64))
        anchors.append(np.frombuffer(blob, dtype=np.uint8, count=n, offset=8 + 9 * n).astype(np.int64))
        data.append(np.frombuffer(blob, dtype=np.uint8, offset=8 + 10 * n))
        sizes.append(int(counts[-1].sum()))
    hit = earlier(*(np.concatenate(v) for v in (counts, anchors, orders, data)))
    parts = np.split(hit, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "bits": [np.packbits(p).tobytes() for p in parts]})


def _finish(buckets: int, splitters: np.ndarray):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _each(batch):
                found = block.candidates(_shared_runs(block, row["known"], buckets))
                order, bucket = found.routed(block, splitters)
                first = np.cumsum(found.segment_count) - found.segment_count
                bits = np.zeros(len(found.sent), dtype=bool)
                for reply in row["told"] or ():
                    part = order[bucket == reply["bucket"]]
                    n = found.segment_count[part]
                    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[part], n)
                    bits[at] = np.unpackbits(np.frombuffer(reply["bits"], dtype=np.uint8), count=int(n.sum())).astype(bool)
                elsewhere = np.zeros(len(found.start), dtype=bool)
                elsewhere[found.sent] = bits
                gone = found.start[found.covered | elsewhere[found.first]]
                yield _counted(block, gone)

    return finish


def _counted(block: Block, gone: np.ndarray) -> pa.RecordBatch:
    """Results of a block's documents when the strings that start at `gone` are removed."""
    step = np.zeros(len(block.data) + 1, dtype=np.int32)
    np.add.at(step, gone, 1)
    np.add.at(step, gone + LENGTH, -1)
    removed = np.cumsum(step[:-1]) > 0
    begins = removed.copy()
    begins[1:] &= ~removed[:-1]
    heads = block.offsets[:-1][block.sizes > 0]
    begins[heads] = removed[heads]
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in (removed, begins)]
    n_removed, n_spans = (s[block.offsets[1:]] - s[block.offsets[:-1]] for s in sums)
    digests = []
    for k, (a, b) in enumerate(zip(block.offsets, block.offsets[1:], strict=False)):
        kept = block.data[a:b][~removed[a:b]] if n_removed[k] else block.data[a:b]
        digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block.ids, pa.int64()), pa.array(block.sizes), pa.array(n_removed), pa.array(n_spans),
            pa.array(digests, pa.string()),
        ],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte is removed if a string of LENGTH bytes over it also starts in a row with a smaller doc_id; null
    ids come last, and rows with the same id (or two null ids) don't count against each other. Null and
    empty texts have 0 bytes, and texts shorter than LENGTH keep all. An empty table gives no rows. Other
    columns are not read; ids are taken as long.
    """

    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    blocks = common.stored(plain.mapInArrow(_blocks, _BLOCKS))
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    buckets = max(1, min(-(-total // BUCKET_BYTES), 1 << 20))
    rate = max(1, total // 14 // (buckets * SAMPLE_PER_BUCKET))
    told = common.stored(blocks.mapInArrow(_tell(buckets, rate), "bucket int, block long, data binary"))
    sample = [np.frombuffer(r.data, dtype=U64) for r in told.where("bucket = -1").select("data").collect()]
    leading = np.sort(np.concatenate(sample)) if sample else np.zeros(0, dtype=U64)
    step = max(1, len(leading) // buckets)
    splitters = np.unique(leading[step::step][: buckets - 1])
    bits = "block long, bucket int, bits binary"
    known = told.where("bucket >= 0").groupBy("bucket").applyInPandas(_shared, bits)
    listed = F.collect_list(F.struct("bucket", "bits"))
    known = common.stored(known.groupBy("block").agg(listed.alias("known")))
    with_known = common.stored(blocks.join(known, "block", "left"))
    sent = with_known.mapInArrow(_send(buckets, splitters), "bucket int, block long, data binary")
    replies = sent.groupBy("bucket").applyInPandas(_sort, bits)
    replies = common.stored(replies.groupBy("block").agg(listed.alias("told")))
    joined = with_known.join(replies, "block", "left")
    return joined.mapInArrow(_finish(buckets, splitters), _RESULT)


