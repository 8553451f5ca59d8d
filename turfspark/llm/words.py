"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of letters and digits: ASCII letters and digits, and any byte of a character outside
ASCII. Upper case is folded for ASCII and Latin-1. Texts come straight from Arrow buffers, so no
Python string is made per text or per word. All functions work on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 2 << 20  # bytes handled at once; a longer text is cut between words, never inside one


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_PLACE = powers(0x9E3779B97F4A7C15 | 1, 4096)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each starts; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return everything[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about `limit` bytes; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def lower(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = low[after]
    upper = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    low[after[upper]] += 0x20
    return low


def bounds(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end position of every word; words don't cross texts."""
    inside = _WORD[low]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[tails] = inside[tails]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashes(low: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(first):
        return np.zeros(0, dtype=U64)
    size = past - first
    begin = np.cumsum(size) - size
    place = np.arange(int(begin[-1] + size[-1])) - np.repeat(begin, size)
    taken = low[place + np.repeat(first, size)]
    values = _BYTE[taken] * _PLACE[place & 4095]
    return mix(np.add.reduceat(values, begin) + size.astype(U64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many each text has."""
    found, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    for a, b in slices(offsets):
        at, end = int(offsets[a]), int(offsets[b])
        while at < end:
            to = end
            if end - at > 2 * PIECE:  # one long text: cut before a byte that is in no word
                to = at + PIECE
                while to < end and _WORD[data[to]]:
                    to += 1
            inner = np.array([at, to]) if to < end or at > offsets[a] else offsets[a : b + 1]
            low = lower(data[at:to])
            first, past = bounds(low, inner - at)
            found.append(hashes(low, first, past))
            if len(inner) == 2:
                counts[a] += len(first)
            else:
                places = np.searchsorted(first, inner - at)
                counts[a:b] += np.diff(places)
            at = to
    return (np.concatenate(found) if found else np.zeros(0, dtype=U64)), counts


def sequence_hashes(words: np.ndarray, counts: np.ndarray, base: int) -> np.ndarray:
    """One 64-bit hash per text for its words in order; 0 words give one fixed value."""
    out = np.zeros(len(counts), dtype=U64)
    some = np.flatnonzero(counts)
    if len(some):
        size = counts[some]
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        out[some] = np.add.reduceat(words * powers(base | 1, int(size.max()))[place], begin)
    return mix(out + counts.astype(U64))


def grams(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and how many each text has; a shorter text has one of all its words."""
    if not len(words):
        return np.zeros(0, dtype=U64), np.zeros(len(counts), dtype=np.int64)
    total = len(words)
    padded = np.concatenate([words, np.zeros(size - 1, dtype=U64)])
    ends = np.repeat(np.cumsum(counts), counts)  # of the text of each word
    out = np.zeros(total, dtype=U64)
    for k in range(size):
        inside = np.arange(k, total + k) < ends
        out += np.where(inside, mix(padded[k : total + k] + U64(k + 1)), U64(0)) * U64(2 * k + 1)
    whole = np.maximum(counts - size + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    place = np.arange(total) - np.repeat(begin, counts)
    return mix(out[place < np.repeat(whole, counts)]), whole
