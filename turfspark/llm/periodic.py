"""Runs of repeated words, found by string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring
word extends and that is at least two periods and `least` words long.

Many documents are laid end to end as one sequence of numbered words, each closed by a number of its own, so
nothing repeats across documents. Hashes of all stretches of 1, 2, 4, ... words are built by doubling. Then, per
scale t = 1, 2, 4, ...:

* A place is in the synchronising set when the smallest hash of the t-word stretches that start within the next t
  places stands at either end of that window, stretches of a period up to t/3 left out. Equal contexts of 2t words
  decide alike, and a window without such a place has a period up to t/3.
* A run of period q in [3t-1, 6t-1) holds a place of the set, and q words on another one of equal context, unless
  its first length - q words have a period up to t/3. So equal contexts at a distance in that range propose q.
* In the excepted case the run joins two neighbouring stretches of one short period, found at a smaller scale;
  the offsets at which their repeated words line up propose the rest. Period 1 is read off directly.

Every proposal is grown in both directions over the stretch hashes as far as words q apart agree, and kept if it is
long enough; of equal stretches the smallest period counts. Contexts that lie less than t/3 apart are periodic and
left out, so a place has at most 18 partners: work is n log n for any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
WORDS = 200_000  # words laid end to end at once; a longer document is alone
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    both = left * _ODD + (right ^ (right >> np.uint64(29))) * _MIX
    both ^= both >> np.uint64(32)
    both *= _ODD
    return both ^ (both >> np.uint64(29))


class _Stretches:
    """Hashes of all stretches of 2^k words; `sizes` are document lengths, longest first."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.sizes, self.ends = sizes, np.cumsum(sizes + 1)
        first = words.astype(np.uint64)
        self.levels = [_mixed(first, first)]
        while sizes.size and 2 ** len(self.levels) <= sizes[0]:
            half = 2 ** (len(self.levels) - 1)
            below = self.levels[-1][: self.upto(2 * half)]
            self.levels.append(_mixed(below[:-half], below[half:]))

    def upto(self, least: int) -> int:
        """Words in the documents of at least that many words, which stand first."""
        n = int(np.searchsorted(-self.sizes, -least, side="right"))
        return int(self.ends[n - 1]) if n else 0

    def grown(self, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch around `place` in which words `period` apart agree: (start, end)."""
        right, left = place.copy(), place.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, size = self.levels[k], 2**k
            fits = np.flatnonzero(right + period < level.size)
            same = fits[level[right[fits]] == level[right[fits] + period[fits]]]
            right[same] += size
            fits = np.flatnonzero((left >= size) & (left - size + period < level.size))
            same = fits[level[left[fits] - size] == level[left[fits] - size + period[fits]]]
            left[same] -= size
        return left, right + period

    def same(self, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of `size` words at two places are equal."""
        level = np.frexp(size.astype(np.float64))[1] - 1
        equal = np.zeros(one.size, bool)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            tail = size[at] - 2**k
            h = self.levels[k]
            equal[at] = (h[one[at]] == h[other[at]]) & (h[one[at] + tail] == h[other[at] + tail])
        return equal


def _merged(found: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), the smallest period for equal stretches."""
    long = (end - start >= 2 * period) & (end - start >= 4)
    rows = np.concatenate([found, np.stack([start[long], end[long], period[long]], axis=1)])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[fresh]


def _same_word(words: np.ndarray) -> np.ndarray:
    cuts = np.flatnonzero(words[1:] != words[:-1]) + 1
    start, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [words.size]])
    return _merged(np.empty((0, 3), np.int64), start, end, np.ones(start.size, np.int64))


def _synchronising(text: _Stretches, k: int, n: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising set of scale 2^k over the first n words, given runs of a period up to 2^k / 3."""
    size = 2**k
    if k == 0:
        return np.arange(n - 1)
    ids = text.levels[k][: n - size + 1].copy()
    if len(periodic):
        inside = periodic[periodic[:, 1] - periodic[:, 0] >= size]
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, inside[:, 0], 1)
        np.add.at(steps, inside[:, 1] - size + 1, -1)
        ids[np.cumsum(steps)[: ids.size] > 0] = _NONE
    low = ids
    for b in range(k):
        low = np.minimum(low[: -(2**b)], low[2**b :])
    low = np.minimum(low[:-1], low[1:])
    return np.flatnonzero((low != _NONE) & ((low == ids[: low.size]) | (low == ids[size:])))


def _equal_contexts(context: np.ndarray, places: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of places with equal contexts at a distance in [low, high)."""
    order = np.argsort(context, kind="stable")
    context, places = context[order], places[order]
    at, lag = np.arange(places.size), 1
    first, apart = [], []
    while True:
        at = at[at + lag < places.size]
        distance = places[at + lag] - places[at]
        near = (context[at + lag] == context[at]) & (distance < high)
        at, distance = at[near], distance[near]
        if not at.size:
            return np.concatenate([np.empty(0, np.int64), *first]), np.concatenate([np.empty(0, np.int64), *apart])
        far = distance >= low
        first.append(places[at[far]])
        apart.append(distance[far])
        lag += 1


def _neighbours(text: _Stretches, periodic: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period in [low, high)) at which two touching stretches of one short period line up."""
    rows = periodic[np.lexsort((periodic[:, 0], periodic[:, 2]))]
    a, b = rows[:-1], rows[1:]
    touch = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1]) & (np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]) >= low - a[:, 2])
    a, b = a[touch], b[touch]
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # where in the second stretch the first one's leading period stands
    p = a[:, 2]
    pair = np.repeat(np.arange(len(a)), p)
    shift = np.arange(pair.size) - np.repeat(np.cumsum(p) - p, p)
    hit = text.same(a[pair, 0], b[pair, 0] + shift, p[pair])
    pair, offset = pair[hit], b[pair[hit], 0] + shift[hit] - a[pair[hit], 0]
    p = p[pair]
    least = low + (offset - low) % p
    many = np.maximum(0, -(-(high - least) // p))
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    pair, period = np.repeat(pair, many), np.repeat(least, many) + step * np.repeat(p, many)
    start = np.maximum(a[pair, 0], b[pair, 0] - period)
    end = np.minimum(b[pair, 1], a[pair, 1] + period)
    fits = end - start >= 2 * period
    return start[fits], period[fits]


def all_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs of at least two periods and four words as rows (start, end, period), by start and period.

    `words` holds the numbered words of several documents, longest first, each followed by a number that
    comes only there; `sizes` are their lengths without it.
    """
    text = _Stretches(words, sizes)
    found = _same_word(words)
    k = 0
    while sizes.size and 2 * (3 * 2**k - 1) <= sizes[0]:
        low, high = 3 * 2**k - 1, 6 * 2**k - 1
        n = text.upto(2 * low)
        periodic = found[(3 * found[:, 2] <= 2**k) & (found[:, 1] <= n)]
        places = _synchronising(text, k, n, periodic)
        proposals = [_equal_contexts(text.levels[k + 1][places], places, low, high)]
        if len(periodic) > 1:
            proposals.append(_neighbours(text, periodic, low, high))
        place, period = (np.concatenate(part) for part in zip(*proposals, strict=True))
        if place.size:
            start, end = text.grown(place, period)
            found = _merged(found, start, end, period)
        k += 1
    return found


def _described(texts: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Per text: number of words, rows (start, length, period), and the text without repetitions."""
    split = [t.split() for t in texts]  # ASCII white space, as bytes are split
    order = sorted(range(len(split)), key=lambda d: -len(split[d]))
    sizes = np.array([len(split[d]) for d in order], np.int64)
    codes, kinds = pd.factorize(np.array([w for d in order for w in split[d]], dtype=object))
    words = np.empty(codes.size + sizes.size, np.int64)
    closing = np.cumsum(sizes + 1) - 1
    inside = np.ones(words.size, bool)
    inside[closing] = False
    words[inside], words[closing] = codes, len(kinds) + np.arange(sizes.size)
    runs = all_runs(words, sizes)
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    bounds = np.searchsorted(runs[:, 0], np.concatenate([closing - sizes, [words.size]]))
    of = {d: k for k, d in enumerate(order)}
    for d in range(len(texts)):
        k = of[d]
        mine = runs[bounds[k] : bounds[k + 1]]
        mine = np.stack([mine[:, 0] - (closing[k] - sizes[k]), mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1)
        mine = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
        kept = split[d]
        if len(mine):
            steps = np.zeros(len(kept) + 1, np.int64)
            np.add.at(steps, mine[:, 0] + mine[:, 2], 1)
            np.add.at(steps, mine[:, 0] + mine[:, 1], -1)
            kept = [kept[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0)]
        yield len(split[d]), mine, b" ".join(kept)


def _batch(ids: list, texts: list[bytes], least: int) -> pa.RecordBatch:
    counts, runs, collapsed = zip(*_described(texts, least), strict=True)
    flat = np.concatenate(runs)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    fields = [pa.array(flat[:, c], pa.int64()) for c in range(3)]
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Runs of repeated words per document: (doc_id, n_words, runs, collapsed), one row per input row.

    Words are stretches of bytes other than space and 0x09 to 0x0D, numbered from 0. `runs` are structs
    (start, length, period) by start, then period. `collapsed` is the words, joined by one space, without those
    that some run holds after its first period.

    Each text is handled whole and alone, so nothing is shuffled and a lost task runs again. Null texts count as
    empty: no words, no runs, an empty `collapsed`. Null and repeated ids are kept as they are. Of very long texts
    the memory is some 8 bytes per word and power of two up to its number of words. Runs that end together
    or overlap are all returned. An empty table gives none. Only `doc_id` and `text` are read, whatever else
    the table holds.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            for doc, text in zip(batch.column(0).to_pylist(), column, strict=True):
                body = text.as_py() or b""
                if texts and size + len(body) > 6 * WORDS:
                    yield _batch(ids, texts, least)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(body)
                size += len(body)
        if texts:
            yield _batch(ids, texts, least)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(described, SCHEMA)
