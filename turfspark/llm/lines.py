"""Line de-duplication by a segment-partition edit join.

Equal lines are counted once. Of each different line of at least FUZZY characters, `tau` + 1 segments are
indexed by (length, number, content); a line within `tau` edits of it must hold one of them unchanged, so
it probes the substrings that can still be that segment, for each length that is near enough. Candidates
that also agree in their letter counts are verified with a banded bit-parallel edit distance. Linked lines
form classes; the first line of a class stays, the others are removed from their documents.

Classes need less: the segments only tell which lines share one with any other line. Short segments are also
shared by chance, the more of them the more lines there are, so those lines are indexed again by pairs of
`tau` + 2 segments, of which two must be unchanged, and the lines of such a key are compared with one of them
in rounds. Only a caller that asks for the links of each line gets all pairs of the single segments.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfspark.llm import common
from turfspark.llm import words as W

TAU = 2
SHORT = 1  # empty lines are left alone
FUZZY = 20  # shorter ones must be equal
PASSES = 1  # parts of the keys that are joined one after the other; each parses the texts again
PIECE = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.zeros(0, dtype=U64), np.zeros(0, dtype=U64)]


class Block:
    """Lines of some texts as ranges of one array of code points."""

    def __init__(self, texts: list[bytes]) -> None:
        parts = [t.decode("utf-8", "replace") for t in texts]
        self.points = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.end = np.flatnonzero(self.points == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(texts) else self.end
        tail = np.cumsum(np.array([len(p) + 1 for p in parts], dtype=np.int64))
        self.owner = np.searchsorted(tail, self.start, side="right")
        self.place = np.arange(len(self.start)) - np.searchsorted(self.owner, self.owner, side="left")
        n = len(self.points)
        if len(_POWERS[0]) < n + 1:
            _POWERS[:] = [W.powers(_BASE, n + 1), W.powers(_BACK, n + 1)]
        values = W.mix(self.points.astype(U64) + U64(1)) * _POWERS[0][:n]
        self.sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(values, dtype=U64)])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each range of characters, wherever it stands."""
        return W.mix((self.sums[end] - self.sums[begin]) * _POWERS[1][begin] + (end - begin).astype(U64))

    def letters(self, rows: np.ndarray) -> np.ndarray:
        """Counts of 8 classes of characters modulo 16 in one 32-bit number per line."""
        size = self.end[rows] - self.start[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[rows], size)
        kind = (self.points[at] * np.uint32(2654435761)) >> np.uint32(29)
        counts = np.bincount(owner * 8 + kind, minlength=8 * len(rows)).reshape(-1, 8) & 15
        return (counts << (4 * np.arange(8))).sum(axis=1).astype(np.uint32).view(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Rows of each batch in blocks of about PIECE bytes, with their lines; texts in `packed` or single lines in `body`."""
    for batch in batches:
        begin, texts, size = 0, [], 0
        whole = "packed" in batch.schema.names
        parts = common.unpacked(batch.column("packed")) if whole else [t.encode("utf-8") for t in batch.column("body").to_pylist()]
        for at, text in enumerate(parts, 1):
            texts.append(text)
            size += len(text)
            if size >= PIECE:
                yield batch.slice(begin, at - begin), Block(texts)
                begin, texts, size = at, [], 0
        if texts:
            yield batch.slice(begin), Block(texts)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row, id, place and hash of every line that takes part."""
    for rows, block in _blocks(batches):
        some = np.flatnonzero(block.end - block.start >= SHORT)
        h = block.hash(block.start[some], block.end[some]).view(np.int64)
        owner = pa.array(block.owner[some])
        yield pa.RecordBatch.from_arrays(
            [rows.column("row").take(owner), rows.column("doc_id").take(owner), pa.array(block.place[some]), pa.array(h)],
            names=["row", "doc_id", "place", "line"],
        )


def segments(length: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the tau + 1 segments, as even as can be, the longer ones last: (segment, line)."""
    base, longer = length // (tau + 1), length % (tau + 1)
    k = np.arange(tau + 1)[:, None]
    extra = np.maximum(k - (tau + 1 - longer), 0)
    return k * base + extra, base + (k >= tau + 1 - longer)


Shape = tuple[int, tuple[tuple[int, int], ...]]


@functools.cache
def single_shapes(tau: int, probe: bool) -> list[Shape]:
    """(less, ((segment, shift),)): where one of tau + 1 segments can stand in a line that is `less` longer."""
    shapes = []
    for less in range(tau + 1 if probe else 1):  # the indexed line is so much shorter
        for k in range(tau + 1):
            low = max(-k, less - (tau - k)) if probe else 0
            high = min(k, less + (tau - k)) if probe else 0
            shapes += [(less, ((k, shift),)) for shift in range(low, high + 1)]
    return shapes


@functools.cache
def pair_shapes(tau: int, probe: bool) -> list[Shape]:
    """(less, ((segment, shift), (segment, shift))): where two of tau + 2 segments can stand.

    For every way to spread the edits over the segments one pair without edits is enough: the first two, the
    last two, or else the first and the last one that are free. A segment is moved by the edits before it.
    """
    n, found = tau + 2, set()
    for total in range(tau + 1):
        for hit in itertools.combinations_with_replacement(range(n), total):
            free = [k for k in range(n) if k not in hit]
            a, b = (0, 1) if free[:2] == [0, 1] else (n - 2, n - 1) if free[-2:] == [n - 2, n - 1] else (free[0], free[-1])
            for moves in itertools.product((-1, 0, 1), repeat=total):
                if sum(moves) >= 0:
                    shifts = [sum(m for k, m in zip(hit, moves, strict=True) if k < end) for end in (a, b)]
                    found.add((sum(moves), ((a, shifts[0]), (b, shifts[1]))))
    return sorted(found) if probe else sorted({(0, ((a, 0), (b, 0))) for _, ((a, _), (b, _)) in found})


def _keys(tau: int, probe: bool, part: int, parts: int, pairs: bool = False, letters: bool = True):
    shapes = (pair_shapes if pairs else single_shapes)(tau, probe)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index entries or probes of the different lines of each block, of one part of the keys."""
        for _, block in _blocks(batches):
            some = np.flatnonzero(block.end - block.start >= FUZZY)
            line = block.hash(block.start[some], block.end[some])
            line, at = np.unique(line, return_index=True)
            some = some[at]
            start, size = block.start[some], block.end[some] - block.start[some]
            cuts = [segments(size - less, tau + pairs) for less in range(tau + 1 if probe else 1)]
            ranges: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

            def moved(less: int, k: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
                """Whether the segment so moved lies in the line, and its hash there."""
                if (less, k, shift) not in ranges:
                    begin, width = cuts[less][0][k] + shift, cuts[less][1][k]
                    fits = (begin >= 0) & (begin + width <= size)
                    a = start + np.where(fits, begin, 0)
                    ranges[less, k, shift] = fits, block.hash(a, a + np.where(fits, width, 0))
                return ranges[less, k, shift]

            out = []
            for less, places in shapes:
                fits, h = moved(less, *places[0])
                tag = places[0][0]
                for place in places[1:]:
                    also, other = moved(less, *place)
                    fits, h, tag = fits & also, W.mix(h + W.mix(other)), tag * 64 + place[0]
                h = W.mix(h ^ W.mix((size - less).astype(U64) * U64(64 if len(places) == 1 else 4096) + U64(tag)))
                own = np.flatnonzero(fits if parts == 1 else fits & (h % U64(parts) == U64(part)))
                out.append((h[own], own))
            own = np.concatenate([o[1] for o in out])
            columns = [pa.array(np.concatenate([o[0] for o in out]).view(np.int64)), pa.array(line[own].view(np.int64))]
            if letters:
                columns.append(pa.array(block.letters(some)[own]))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "line", "letters"][: len(columns)])

    return keys


def letter_distance(a: Column, b: Column) -> Column:
    """At most twice the edits: the sum of differences of the eight counts."""
    total = F.lit(0)
    for k in range(8):
        apart = F.abs(F.shiftright(a, 4 * k).bitwiseAND(15) - F.shiftright(b, 4 * k).bitwiseAND(15))
        total = total + F.least(apart, 16 - apart)
    return total


def edit_distances(left: list[str], right: list[str], tau: int) -> np.ndarray:
    """Edit distance of each pair, tau + 1 where it is larger; tau up to 30.

    Myers' column step on the 2 tau + 1 rows around the diagonal, one word per pair and all pairs at once;
    the window moves down one row with each column. The distance of the lowest row is carried along, and at
    the last column one climbs from there to the last row of the left text.
    """
    n = len(left)
    if not n:
        return np.zeros(0, dtype=np.int64)
    size_a = np.array([len(t) for t in left])
    size_b = np.array([len(t) for t in right])
    result = np.full(n, tau + 1)
    near = np.flatnonzero(np.abs(size_a - size_b) <= tau)
    if not len(near):
        return result
    order = near[np.argsort(-size_b[near], kind="stable")]
    height, width = int(size_a[order].max()), int(size_b[order].max())
    # a is padded by tau rows above and enough below, with characters that are in no text
    rows_a = np.full((len(order), tau + max(height, width) + tau + 2), 0xFFFFFFFF, dtype=np.uint32)
    rows_b = np.full((len(order), width), 0xFFFFFFFE, dtype=np.uint32)
    for k, i in enumerate(order):
        rows_a[k, tau : tau + size_a[i]] = np.frombuffer(left[i].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        rows_b[k, : size_b[i]] = np.frombuffer(right[i].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    band = 2 * tau + 1
    full = U64((1 << band) - 1)
    up = np.full(len(order), int(full) & ~((1 << tau) - 1), dtype=U64)  # vertical steps up by one, rows from 1 on
    down = np.zeros(len(order), dtype=U64)
    score = np.full(len(order), tau, dtype=np.int64)
    last = np.searchsorted(-size_b[order], -np.arange(width), side="left")
    one = U64(1)
    for j in range(width):
        m = int(last[j])
        same = np.zeros(m, dtype=U64)
        for k in range(band):
            same |= (rows_a[:m, j + k] == rows_b[:m, j]).astype(U64) << U64(k)
        u, d = up[:m], down[:m]
        diagonal = ((((same & u) + u) ^ u) | same | d) & full
        more = (d | ~(diagonal | u)) & full
        less = diagonal & u
        score[:m] += 1 - ((diagonal >> U64(band - 1)) & one).astype(np.int64)
        shifted = diagonal >> one
        new_up, new_down = (less | ~(shifted | more)) & full, shifted & more
        done = size_b[order[:m]] == j + 1
        if done.any():
            # vertical steps of this column, row by row from the lowest one up
            full_up = ((less << one) | ~(diagonal | ((more << one) | one))) & full
            full_down = diagonal & ((more << one) | one)
            for i in np.flatnonzero(done):
                value = int(score[i])
                for row in range(j + 1 + tau, int(size_a[order[i]]), -1):
                    bit = U64(row - (j + 1 - tau))
                    value -= int((full_up[i] >> bit) & one) - int((full_down[i] >> bit) & one)
                result[order[i]] = min(value, tau + 1)
        up[:m], down[:m] = new_up, new_down
    empty = order[size_b[order] == 0]
    result[empty] = np.minimum(size_a[empty], tau + 1)
    return result


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, found = [], []
        for text, some in zip(common.unpacked(batch.column("packed")), batch.column("some").to_pylist(), strict=True):
            parts = text.decode("utf-8", "replace").split("\n")
            lines += [s["line"] for s in some]
            found += [parts[s["place"]] for s in some]
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(found, pa.string())], names=["line", "body"])


def _verify(tau: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist()
            size = np.array([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], dtype=np.int64)
            order = np.argsort(size, kind="stable")
            edits = np.zeros(len(left), dtype=np.int64)
            at = 0
            while at < len(order):
                # pairs of similar length together: each is padded to the longest of its group
                to = at + 1
                while to < len(order) and (to + 1 - at) * int(size[order[to]]) <= PIECE * 4:
                    to += 1
                some = order[at:to]
                edits[some] = edit_distances([left[i] for i in some], [right[i] for i in some], tau)
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(edits)], names=["a", "b", "edits"])

    return verify


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, kept = [], [], []
        for text, places in zip(common.unpacked(batch.column("packed")), batch.column("places").to_pylist(), strict=True):
            parts = text.split(b"\n")
            drop = set(places or ())
            counts.append(len(parts) if text else 0)
            gone.append(len(drop))
            kept.append((b"\n".join(p for i, p in enumerate(parts) if i not in drop) if drop else text).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            names=["row", "n_lines", "n_removed", "text"],
        )


def _entries(rows: DataFrame, tau: int, part: int, probe: bool, *, pairs: bool = False, letters: bool = True) -> DataFrame:
    columns = "key long, line long" + (", letters int" if letters else "")
    return rows.mapInArrow(_keys(tau, probe, part, PASSES, pairs, letters), columns)


def _near(tau: int):
    return lambda a, b: letter_distance(a, b) <= 2 * tau


def _bodies(rows: DataFrame, some: DataFrame, first: DataFrame) -> DataFrame:
    """(line, body) of the lines in `some`, stored."""
    where = (
        first.join(some.select("line").distinct(), "line")
        .groupBy("head.row")
        .agg(F.collect_list(F.struct("line", F.col("head.place").alias("place"))).alias("some"))
    )
    joined = rows.select("row", "packed").join(common.stored(where), "row")
    return common.stored(joined.select("packed", "some").mapInArrow(_texts, "line long, body string"))


def _verified(pairs: DataFrame, bodies: DataFrame, tau: int) -> DataFrame:
    joined = pairs.join(bodies.select(F.col("line").alias("a"), F.col("body").alias("body_a")), "a").join(
        bodies.select(F.col("line").alias("b"), F.col("body").alias("body_b")), "b"
    )
    near = joined.select("a", "b", "body_a", "body_b").mapInArrow(_verify(tau), "a long, b long, edits long")
    return near.where(F.col("edits") <= tau).select("a", "b")


def links(rows: DataFrame, first: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b): hashes of all different lines within `tau` edits. `first` has line, head (row, place)."""
    pairs = None
    for part in range(PASSES):
        texts = rows.select("row", "packed")
        index = _entries(texts, tau, part, False).groupBy("key", F.col("line").alias("b")).agg(F.min("letters").alias("lb"))
        probes = _entries(texts, tau, part, True).select("key", F.col("line").alias("a"), F.col("letters").alias("la"))
        found = probes.join(index, "key").where(F.col("a") != F.col("b")).where(_near(tau)(F.col("la"), F.col("lb")))
        found = common.stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        pairs = found if pairs is None else pairs.union(found)
    pairs = common.stored(pairs.distinct())
    some = pairs.select(F.col("a").alias("line")).union(pairs.select("b"))
    return _verified(pairs, _bodies(rows, some, first), tau)


def _candidates(rows: DataFrame, tau: int, part: int) -> DataFrame:
    """(line): lines with a segment that one line is indexed by and another one probes.

    Every index entry is among the probes of its line too. So it takes one indexed line per key to find
    the keys that count, whatever the number of their lines, and a probe is joined with one row at most.
    """
    texts = rows.select("row", "packed")
    index = _entries(texts, tau, part, False, letters=False).groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    hits = _entries(texts, tau, part, True, letters=False).join(index, "key").where("line <> low or line <> high")
    return common.stored(hits.select(F.explode(F.array("line", "low")).alias("line")).distinct())


def _shared(bodies: DataFrame, tau: int, part: int) -> DataFrame:
    """(band, node, hint): keys of two segments that one line is indexed by and another one probes, with all their lines."""
    entry = F.struct("line", "letters")
    index = _entries(bodies, tau, part, False, pairs=True).groupBy("key").agg(F.min(entry).alias("low"), F.max("line").alias("high"))
    hits = _entries(bodies, tau, part, True, pairs=True).join(index, "key").where("line <> low.line or line <> high")
    hits = common.stored(hits.select("key", "line", "letters", "low"))
    own = hits.select("key", "line", "letters")
    every = own.union(hits.select("key", "low.line", "low.letters")).distinct()
    return every.select(F.col("key").alias("band"), F.col("line").alias("node"), F.col("letters").alias("hint"))


def classes(rows: DataFrame, first: DataFrame, tau: int = TAU) -> DataFrame:
    """(line, label): classes of different lines that links of at most `tau` edits join. `first` as in `links`."""
    some = functools.reduce(DataFrame.union, [_candidates(rows, tau, part) for part in range(PASSES)])
    bodies = _bodies(rows, some, first)
    shared = functools.reduce(DataFrame.union, [_shared(bodies, tau, part) for part in range(PASSES)])
    shared = common.distinct_buckets(shared)
    label = common.bucket_classes(shared, lambda pairs: _verified(pairs, bodies, tau), _near(tau))
    return label.withColumnRenamed("node", "line")


def line_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = TAU, degrees: bool = True) -> DataFrame:
    """One row per input row: row, doc_id, n_lines, n_removed, n_links or n_alike, text (without the removed lines).

    Lines are what stands between line feeds. Those of SHORT characters or more that are equal to, or (from
    FUZZY characters on) linked by at most `tau` edits with, a line of a smaller doc_id (null ids last, then
    the order of rows and lines) are removed; links may go over several lines. With `degrees` n_links counts
    the links of the row's lines to different lines, which makes as many pairs as there are links; without,
    n_alike counts the other different lines in the classes of the row's lines, and pairs are compared in
    rounds. Null texts become empty; empty texts have no lines. A very long line is compared by itself, in
    memory of some 20 bytes a character. Lines are told apart by 64-bit hashes. Other columns are not read;
    an empty table gives no rows.
    """
    return decide(common.packed(docs, doc_id=doc_id, text=text), tau, degrees)


def decide(rows: DataFrame, tau: int = TAU, degrees: bool = False) -> DataFrame:
    """`line_duplicates` of rows that are packed already (row, doc_id, packed)."""
    kind = dict(rows.dtypes)["doc_id"]
    order = F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row"), F.col("place")
    )
    lines = rows.select("row", "doc_id", "packed").mapInArrow(_lines, f"row long, doc_id {kind}, place long, line long")
    placed = common.stored(lines.select("line", order.alias("head")))
    first = common.stored(placed.groupBy("line").agg(F.min("head").alias("head"), F.count(F.lit(1)).alias("n")))
    if degrees:
        linked = common.stored(links(rows, first, tau))
        both = linked.union(linked.select(F.col("b"), F.col("a")))
        degree = both.groupBy(F.col("a").alias("line")).agg(F.count(F.lit(1)).alias("links"))
        label = common.stored(common.components(linked).withColumnRenamed("node", "line").join(degree, "line"))
    else:
        label = classes(rows, first, tau)
    named = common.stored(first.join(label, "line"))
    heads = named.groupBy("label").agg(F.min("head").alias("first"), (F.count(F.lit(1)) - 1).alias("others"))
    grouped = named.join(heads, "label").select("line", "first", "links" if degrees else F.col("others").alias("links"))
    alone = first.where("n > 1").join(label.select("line"), "line", "left_anti")
    found = common.stored(grouped.union(alone.select("line", "head", F.lit(0).cast("long"))))
    # only lines of classes of two or more get this far
    hits = placed.join(found, "line").select("head", "first", "links")
    gone = F.when(F.col("head") != F.col("first"), F.col("head.place"))
    by_row = hits.groupBy("head.row").agg(F.collect_list(gone).alias("places"), F.sum("links").alias("n_links"))
    joined = rows.join(common.stored(by_row), "row", "left")
    stripped = joined.select("row", "doc_id", "n_links", "packed", "places").mapInArrow(
        _with_columns(_strip), f"row long, doc_id {kind}, n_links long, n_lines long, n_removed long, text string"
    )
    number = F.coalesce("n_links", F.lit(0)).alias("n_links" if degrees else "n_alike")
    return stripped.select("row", "doc_id", "n_lines", "n_removed", number, "text")


def _with_columns(step):
    """Puts doc_id and n_links of the input beside what `step` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in step(iter([batch])):
                yield pa.RecordBatch.from_arrays(
                    [out.column("row"), batch.column("doc_id"), batch.column("n_links"), *out.columns[1:]],
                    names=["row", "doc_id", "n_links", *out.schema.names[1:]],
                )

    return run
