"""Language identification by cross-parsing against suffix automata.

A suffix automaton per language is built from a bounded sample of labelled text. A text is parsed
greedily: each phrase is the longest match with anything in the language's sample, the next one starts
after it. The language that needs the fewest phrases per letter wins. All distinct sentences of a text
are parsed: it is cut into pieces of `SEGMENT` letters, which end a phrase for every language alike, and the
automata of all languages run over many pieces in step, as table look-ups on arrays.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


UNKNOWN = "und"
SAMPLE_TEXTS = 250  # labelled texts per language, the bound of the sample
SAMPLE_CHARS = 400  # characters taken of each
MODEL_CHARS = 240_000  # characters of all languages together
LETTERS = 62  # letters told apart; rarer ones count as one
SEGMENT = 256
POINTS = 0x110000
BATCH_CHARS = 1 << 21
SENTENCE = re.compile(r"[.!?\n]\s*")
_NEW = np.int32(-(2**31))

_ALPHA: list[np.ndarray] = []
_BUILT: dict[tuple, Parser] = {}


def _alpha() -> np.ndarray:
    """Which code points are letters."""
    if not _ALPHA:
        _ALPHA.append(np.array([chr(i).isalpha() for i in range(POINTS)]))
    return _ALPHA[0]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, depth, last = [-1], [0], 0
    for code in codes:
        new = len(step)
        step.append({})
        depth.append(depth[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in step[at]:
            step[at][code] = new
            at = link[at]
        if at >= 0:
            to = step[at][code]
            if depth[to] == depth[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(step[to].copy())
                depth.append(depth[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(code) == to:
                    step[at][code] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return step


class Parser:
    """Automata of all languages as one table: entry = next state, negative where a new phrase begins."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        counts = np.zeros(POINTS, dtype=np.int64)
        points = {}
        for name in self.languages:
            points[name] = np.frombuffer(samples[name].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            counts += np.bincount(points[name][_alpha()[points[name]]], minlength=POINTS)
        common_letters = np.argsort(-counts, kind="stable")[:LETTERS]
        common_letters = common_letters[counts[common_letters] > 0]
        self.classes = np.where(_alpha(), 1, 0).astype(np.uint8)  # 0: no letter, 1: a rare letter
        self.classes[common_letters] = np.arange(2, 2 + len(common_letters))
        self.width = int(self.classes.max()) + 1
        tables, base, self.roots = [], 0, []
        for name in self.languages:
            codes, _ = self.codes([samples[name]])
            states = suffix_automaton(codes.tolist())
            table = np.full((len(states), self.width), -1, dtype=np.int32)
            for state, row in enumerate(states):
                table[state, list(row)] = list(row.values())
            table = np.where(table >= 0, (table + base) * self.width, -1).astype(np.int32)
            # where a phrase can't go on the next one begins; the row added at the end is where none has begun
            outside = (base + len(states)) * self.width
            again = np.where(table[0] >= 0, table[0], outside) | _NEW
            tables.append(np.concatenate([np.where(table >= 0, table, again[None, :]), again[None, :]]))
            self.roots.append(outside)
            base += len(states) + 1
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int32)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter classes of all texts in order, runs of other characters as one 0; and where each text ends.

        A sentence that repeats within a text is taken once: it says no more about the language.
        """
        small = [". ".join(dict.fromkeys(SENTENCE.split(t.lower()))) for t in texts]
        points = np.frombuffer(" ".join(small).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.classes[points]
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        past = np.cumsum(np.array([len(t) + 1 for t in small], dtype=np.int64))
        keep[past[:-1] - 1] = False  # no text has the space that joins it to the next
        kept = np.concatenate([[0], np.cumsum(keep)])
        return codes[keep], kept[np.minimum(past, len(points))]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by language and text, and letters by text."""
        codes, ends = self.codes(texts)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        letters = np.concatenate([[0], np.cumsum(codes > 0)])
        letters = letters[ends] - letters[begins]
        pieces = -(-(ends - begins) // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begins[owner] + place * SEGMENT
        size = np.minimum(ends[owner] - start, SEGMENT)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        left = np.searchsorted(-size, -np.arange(SEGMENT), side="left")  # pieces longer than each step
        state = np.repeat(np.array(self.roots, dtype=np.int32)[:, None], len(owner), axis=1)
        found = np.zeros(state.shape, dtype=np.int32)
        for k in range(SEGMENT):
            n = int(left[k])
            if not n:
                break
            to = self.table.take(state[:, :n] + codes[start[:n] + k])
            found[:, :n] -= to >> 31
            state[:, :n] = to & 0x7FFFFFFF
        total = np.array([np.bincount(owner, weights=row, minlength=len(texts)) for row in found])
        return total.reshape(len(self.languages), len(texts)), letters

    def best(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        total, letters = self.phrases(texts)
        for i in range(len(texts)):
            if not letters[i] or not self.languages:
                names.append(UNKNOWN)
                continue
            rates = total[:, i]
            k = int(np.argmin(rates))  # ties: the first name
            others = np.delete(rates, k)
            names.append(self.languages[k])
            scores[i] = 1.0 - rates[k] / others.min() if len(others) else 1.0
        return names, scores


def sample_texts(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang") -> dict[str, str]:
    """A bounded sample of labelled text per language: at most SAMPLE_TEXTS distinct texts of each.

    Which texts are taken depends on a hash of the text alone. One pass counts the distinct texts of each
    language, a second one takes a share that gives four times the bound, of which the bound is kept: the
    first by hash, whatever the share.
    """
    rows = docs.where(training & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}")).select(
        F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("h")
    )
    distinct = rows.select("lang", "h").distinct()
    counts = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    bar = F.lit(0)
    for name, n in sorted(counts.items()):
        bar = F.when(F.col("lang") == name, min(1 << 20, 1 + (4 * SAMPLE_TEXTS << 20) // n)).otherwise(bar)
    share = F.pmod(F.col("h"), F.lit(1 << 20))
    taken = (
        rows.where(share < bar)
        .groupBy("lang", "h")
        .agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("part"))
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(share, "h")))
        .where(F.col("n") <= SAMPLE_TEXTS)
    )
    parts: dict[str, list[str]] = {}
    for r in sorted(taken.collect(), key=lambda r: (r.lang, r.n)):
        parts.setdefault(r.lang, []).append(r.part)
    if not parts:
        return {}
    # in a task: the automata need more memory than a driver should spend
    rows = docs.sparkSession.createDataFrame([(json.dumps(parts),)], "parts string").coalesce(1)
    return json.loads(rows.mapInPandas(_clean, "samples string").first().samples)


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"samples": [json.dumps(cleaned(json.loads(p))) for p in batch["parts"]]})


def cleaned(parts: dict[str, list[str]]) -> dict[str, str]:
    """Sample per language without sentences that don't belong to it.

    Passages that wander between languages (boilerplate, quotations, wrong labels) would let a whole
    repeated passage count as one phrase. So each sentence is taken once, sentences of two languages
    are dropped, and each half of the sample is parsed against automata of the other half: a sentence
    stays if its own language needs no more phrases than any other.
    """
    sentences = {name: dict.fromkeys(s for p in found for s in SENTENCE.split(p) if s) for name, found in parts.items()}
    seen = Counter(s for found in sentences.values() for s in found)
    bound = MODEL_CHARS // max(1, len(parts))
    halves: list[dict[str, list[str]]] = [{}, {}]
    for name, found in sentences.items():
        size = 0
        for i, sentence in enumerate(s for s in found if seen[s] == 1):
            if size + len(sentence) > bound:
                break
            size += len(sentence) + 2
            halves[i % 2].setdefault(name, []).append(sentence)
    out: dict[str, list[str]] = {}
    for own, other in (halves, halves[::-1]):
        parser = Parser({name: ". ".join(found) for name, found in other.items()})
        for name, found in own.items():
            total, _ = parser.phrases(found)
            best = total.min(axis=0) if len(total) else np.zeros(len(found))
            mine = total[parser.languages.index(name)] if name in parser.languages else best
            out.setdefault(name, []).extend(s for s, a, b in zip(found, mine, best, strict=True) if a <= b)
    return {name: ". ".join(found) for name, found in out.items()}


def _predict(samples: dict[str, str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(sorted(samples.items()))
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Parser(samples)
        parser = _BUILT[key]
        for batch in batches:
            names, scores = [], []
            column, at = batch.column("text"), 0
            while at < len(column):
                texts, size = [], 0
                while at < len(column) and size < BATCH_CHARS:
                    texts.append(column[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                found, sure = parser.best(texts)
                names += found
                scores.append(sure)
            out = [batch.column(c) for c in batch.schema.names if c != "text"]
            kept = [c for c in batch.schema.names if c != "text"]
            sure = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=[*kept, "lang_pred", "score"]
            )

    return predict


def identify(rows: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """All columns of `rows` but the text, with lang_pred and score (0: two languages tie, to 1).

    Null texts and texts without a letter get `und` and score 0, and so do all texts if no language
    was learned; with a single learned language the score is 1. Repeated rows get equal answers, ties
    go to the first name. `rows` must have no columns named lang_pred or score.
    """
    others = [f for f in rows.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["lang_pred string", "score double"])
    renamed = rows.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{text}`").alias("text"))
    return renamed.mapInArrow(_predict(samples), schema)


def held_out(doc_id: str, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; false for a null id."""
    left = F.crc32(F.encode(F.col(f"`{doc_id}`").cast("string"), "UTF-8")) % divisor
    return F.coalesce(left == remainder, F.lit(False))


def language_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows that are not held out."""
    apart = held_out(doc_id, 5, 0)
    samples = sample_texts(docs, ~apart & F.col(f"`{doc_id}`").isNotNull(), text, lang)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), apart.alias("held_out"), F.col(f"`{text}`").alias("text"))
    return identify(rows, samples)


