"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, in benchmark items and documents alike. Windows of
`WINDOW` template tokens of the documents are joined by hash with those of the items; hits that go on
at the same distance form runs. A run counts if it covers `RUN` tokens (or the whole item, if that is
shorter) and its slots are consistent: every value of the item stands for one value of the document and
the other way round. So a question with other numbers or names is found, a text that only looks
similar is not. At least half of a run is literal, unless it equals the item word for word. Of a run that
fails, the longest stretches of `RUN` tokens that meet one of these rules count.

The windows of a bounded block of items (`BLOCK_CHARS`) go to the tasks; a larger benchmark is taken
block by block within the same pass over the documents, which are never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark.llm import words as W

WINDOW = 8
RUN = 13
SHORTEST = 4  # items with fewer words are too common to be told from other text, and are not searched
BLOCK_CHARS = 4 << 20
# Unit words.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg gram grams kilogram kilograms "
    "lb lbs pound pounds oz ounce ounces ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees hz khz mhz ghz w kw mw j kj cal kcal "
    "v volt volts amp amps kb mb gb tb byte bytes kmh mph"
).split()
NUMBER, NAME, UNIT = (W.mix(np.array([k], dtype=np.uint64))[0] for k in (1, 2, 3))
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?:;\n"]] = True
_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64())]))
MATCHES = "array<struct<item_id: bigint, start: bigint, tokens: bigint>>"


def _span_hashes(texts: list[str]) -> np.ndarray:
    data, offsets = W.utf8(pa.array(texts, pa.string()))
    return W.word_hashes(data, offsets)[0]


_UNITS = np.sort(_span_hashes(UNITS))


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens and values of the words of all texts in order, and how many each text has.

    A word that starts with a digit is a number. A capitalised word is a name unless it begins a sentence.
    """
    low = W.lower(data)
    first, past = W.bounds(low, offsets)
    values = W.hashes(low, first, past)
    counts = np.diff(np.searchsorted(first, offsets))
    if not len(first):
        return values, values, counts
    tokens = values.copy()
    tokens[_UNITS[np.minimum(np.searchsorted(_UNITS, values), len(_UNITS) - 1)] == values] = UNIT
    capital = low[first] != data[first]
    latin = (data[first] == 0xC3) & (past - first > 1)
    capital[latin] = low[first[latin] + 1] != data[first[latin] + 1]
    # the rest of a name is in small letters; a word all in capitals is shouting, not a name
    second = first + np.where(data[first] >= 0xC0, 2, 1)
    small = (second < past) & (low[np.minimum(second, len(low) - 1)] == data[np.minimum(second, len(low) - 1)])
    ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
    begins = np.ones(len(first), dtype=bool)
    begins[1:] = ends[first[1:]] > ends[past[:-1]]
    heads = np.searchsorted(first, offsets[:-1][counts > 0])
    begins[heads] = True
    tokens[capital & small & ~begins] = NAME
    tokens[(data[first] >= 48) & (data[first] <= 57)] = NUMBER
    return tokens, values, counts


def windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` tokens across the whole array."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out += W.mix(tokens[k : k + n] + np.uint64(k)) * np.uint64(2 * k + 3)
    return W.mix(out)


class Index:
    """Windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        data, offsets = W.utf8(pa.array([t for _, t in items], pa.string()))
        tokens, values, counts = template(data, offsets)
        begin = np.concatenate([[0], np.cumsum(counts)])
        self.tokens = [tokens[a:b] for a, b in zip(begin, begin[1:], strict=False)]
        self.values = [values[a:b] for a, b in zip(begin, begin[1:], strict=False)]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, own in enumerate(self.tokens):
            size = min(WINDOW, len(own))
            if size >= SHORTEST:
                for place, h in enumerate(windows(own, size)):
                    found.setdefault(size, []).append((int(h), i, place))
        self.sizes = {}
        for size, rows in found.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], dtype=np.uint64)
            mask = np.zeros(1 << 20, dtype=bool)
            mask[keys >> np.uint64(44)] = True
            self.sizes[size] = (keys, [r[1:] for r in rows], mask)

    def matches(self, tokens: np.ndarray, values: np.ndarray, begin: int, end: int, hits) -> list[dict]:
        """Runs of one document from its (place, size, item, item's place)."""
        out, runs = [], {}
        for place, size, item, at in hits:
            runs.setdefault((item, place - at), []).append((at, size))
        for (item, shift), places in sorted(runs.items()):
            need = min(RUN, len(self.tokens[item]))
            places.sort()
            low, high = places[0][0], places[0][0] + places[0][1]
            for at, size in [*places[1:], (1 << 40, 0)]:
                if at <= high - size + 1 and size:
                    high = at + size
                    continue
                if high - low >= need:
                    for start, end in self.accepted(item, low, high, need, tokens, values, shift):
                        out.append({"item_id": self.ids[item], "start": start + shift - begin, "tokens": end - start})
                low, high = at, at + size
        return out

    def accepted(self, item: int, low: int, high: int, need: int, tokens, values, shift: int) -> list[tuple[int, int]]:
        """The whole run, or its longest stretches of `need` tokens that are literal or consistent; none overlap."""
        own = self.tokens[item][low:high]
        slot = (own == NUMBER) | (own == NAME) | (own == UNIT)
        ours, theirs = self.values[item][low:high], values[low + shift : high + shift]
        equal = ours == theirs
        if equal.all():
            return [(low, high)]
        contested = _contested(ours, theirs, slot)
        if not contested.any() and 2 * slot.sum() <= len(own):
            return [(low, high)]
        found = [(a, b) for a, b in _stretches(equal) if b - a >= need]
        pairs = list(zip(ours.tolist(), theirs.tolist(), strict=True))
        balance = np.concatenate([[0], np.cumsum(np.where(slot, -1, 1))]).tolist()
        todo = _one_to_one(pairs, slot.tolist(), need) if contested.any() else [(0, len(own))]
        doubtful = contested & ~equal
        while todo:
            a, b = todo.pop()
            # a value that the run contradicts elsewhere must come twice to count as put in for another
            seen = Counter(pairs[i] for i in np.flatnonzero(doubtful[a:b]) + a)
            once = [i for i in np.flatnonzero(doubtful[a:b]) + a if seen[pairs[i]] == 1]
            if once:
                edges = [a - 1, *once, b]
                todo += [(x + 1, y) for x, y in zip(edges, edges[1:], strict=False) if y - x - 1 >= need]
            else:
                found += _half_literal(balance, a, b, need)
        taken: list[tuple[int, int]] = []
        for a, b in sorted(set(found), key=lambda r: (r[0] - r[1], r[0])):
            k = bisect_left(taken, (a, b))
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
                taken.insert(k, (a, b))
        return [(low + a, low + b) for a, b in taken]


def _contested(ours: np.ndarray, theirs: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Slots whose value stands for several, or is put for several, in the run."""
    there: dict[int, set] = {}
    back: dict[int, set] = {}
    for a, b in zip(ours[slot].tolist(), theirs[slot].tolist(), strict=True):
        there.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)
    out = np.zeros(len(slot), dtype=bool)
    out[slot] = [
        len(there[a]) > 1 or len(back[b]) > 1 for a, b in zip(ours[slot].tolist(), theirs[slot].tolist(), strict=True)
    ]
    return out


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _one_to_one(pairs: list[tuple[int, int]], slot: list[bool], need: int) -> list[tuple[int, int]]:
    """Longest ranges of `need` tokens in which the slots map one to one, by moving both ends."""
    out, start = [], 0
    there: dict[int, list[int]] = {}  # value of the item: value of the document, slots in the range
    back: dict[int, list[int]] = {}
    for end in range(len(pairs)):
        if not slot[end]:
            continue
        a, b = pairs[end]
        if there.get(a, (b,))[0] != b or back.get(b, (a,))[0] != a:
            if end - start >= need:
                out.append((start, end))
            while there.get(a, (b,))[0] != b or back.get(b, (a,))[0] != a:
                if slot[start]:
                    for side, key in ((there, pairs[start][0]), (back, pairs[start][1])):
                        side[key][1] -= 1
                        if not side[key][1]:
                            del side[key]
                start += 1
        there.setdefault(a, [b, 0])[1] += 1
        back.setdefault(b, [a, 0])[1] += 1
    if len(pairs) - start >= need:
        out.append((start, len(pairs)))
    return out


def _half_literal(balance: list[int], a: int, b: int, need: int) -> list[tuple[int, int]]:
    """Of each end in the range the longest part of `need` tokens that is at least half literal."""
    if balance[b] >= balance[a]:
        return [(a, b)]
    first: dict[int, int] = {}  # literal less slot words so far: the first place
    out = []
    for end in range(a, b + 1):
        first.setdefault(balance[end], end)
        start = a if balance[end] >= balance[a] else first[balance[end]]
        if end - start >= need:
            out.append((start, end))
    return out


def _find(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """Runs of each text."""
    tokens, values, counts = template(data, offsets)
    begin = np.concatenate([[0], np.cumsum(counts)])
    found: dict[int, list] = {}
    for size, (keys, where, mask) in index.sizes.items():
        seen = windows(tokens, size)
        place = np.flatnonzero(mask[seen >> np.uint64(44)])
        left = np.searchsorted(keys, seen[place], side="left")
        right = np.searchsorted(keys, seen[place], side="right")
        hit = right > left
        place, left, right = place[hit], left[hit], right[hit]
        text = np.searchsorted(begin, place, side="right") - 1
        inside = place + size <= begin[text + 1]
        for p, a, b, t in zip(place[inside], left[inside], right[inside], text[inside], strict=True):
            found.setdefault(int(t), []).extend((int(p), size, *where[k]) for k in range(a, b))
    out: list[list[dict]] = [[] for _ in counts]
    for t, hits in found.items():
        out[t] = index.matches(tokens, values, int(begin[t]), int(begin[t + 1]), hits)
    return out


def _match(items: list[tuple[int, str]]):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            found = []
            for a, b in W.slices(offsets):
                found += _find(index, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = batch.schema.names.index("matches")
            if batch.num_rows:
                before = batch.column("matches").to_pylist()
                found = [(x or []) + y for x, y in zip(before, found, strict=True)]
            yield batch.set_column(at, batch.schema.field("matches"), pa.array(found, batch.schema.field("matches").type))

    return match


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about BLOCK_CHARS characters; an item without id or text is left out."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull()
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // BLOCK_CHARS)
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k)
        yield sorted((r.id, r.text) for r in part.collect())


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """`docs` as a struct `payload`, and `matches`: one entry per run (item_id, start word, tokens).

    Null and empty texts have no matches; repeated rows get equal ones; an empty benchmark gives none.
    Columns of any name may be in `docs`.
    """
    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("payload"),
        F.col(f"`{text}`").alias("text"),
        F.lit(None).cast(MATCHES).alias("matches"),
    )
    for items in blocks(benchmark):
        found = found.mapInArrow(_match(items), found.schema)
    return found.select("payload", F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, matched_tokens (of the longest run), item_ids of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = with_matches(rows, benchmark)
    ids = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return found.select(
        F.col("payload.doc_id").alias("doc_id"),
        (F.size("matches") > 0).alias("contaminated"),
        F.size(ids).alias("n_items"),
        F.coalesce(F.array_max("matches.tokens"), F.lit(0)).alias("matched_tokens"),
        ids.alias("item_ids"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark passage, with their columns."""
    return with_matches(docs, benchmark, text).where(F.size("matches") == 0).select("payload.*")
