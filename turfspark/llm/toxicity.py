"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits written for letters, everything else to spaces) and searched
with one Aho-Corasick automaton for all lexicon entries and exception phrases. Entries are whole words,
or beginnings of words, with a weight: the log odds of the entry among toxic and other texts of a
bounded labelled sample. Matches inside an exception phrase don't count. The sum of the weights, also
divided by the length of the text, goes through a logistic function fitted on the same sample.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turfspark.llm.langid import held_out

SAMPLE_TOXIC, SAMPLE_OTHER = 4000, 12000  # labelled texts learned from, at most about so many of each kind
LEXICON = 5000  # entries
STEMS = (3, 4, 5, 6)  # beginnings of words that may become entries
MIN_TEXTS = 5  # toxic texts of the sample that must have an entry
MIN_ODDS = 4.5  # natural log
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, and digits or signs written for letters.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁһӏкмтвнαοερντικυχ",
    "aeopcyxijsdhlkmtbhaoepvtikux",
)
SUBSTITUTES = str.maketrans("013457@$", "oieastas")
# Harmless phrases that have a lexicon word in them.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "clownfish", "pathetic fallacy", "idiot proof",
    "stupid question", "sore loser", "pond scum", "soap scum", "recycle trash",
)


class _Fold(dict):
    """Translation table made as characters turn up: letters stay, folded; all else becomes a space."""

    def __missing__(self, point: int) -> str:
        small = chr(point).casefold().translate(HOMOGLYPHS).translate(SUBSTITUTES)
        self[point] = small if small.isalnum() else " "
        return self[point]


_FOLD = _Fold()


def fold(text: str) -> str:
    """A space, the folded words, each followed by a space."""
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " stem" or " word "
    exceptions: Sequence[str] = EXCEPTIONS
    bias: float = -3.0
    total: float = 0.0  # factor of log(1 + sum of weights)
    density: float = 0.0  # factor of log(1 + sum of weights per root of words)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (len(fold(phrase)), None))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def features(self, automaton: ahocorasick.Automaton | None, text: str) -> tuple[float, float, int]:
        """Sum of weights, the sum by the root of the number of words, and the matches that count."""
        folded = fold(text)
        if automaton is None:
            return 0.0, 0.0, 0
        hits, spared = [], []
        for end, (size, weight) in automaton.iter(folded):
            (hits if weight is not None else spared).append((end - size + 1, end, weight))
        if spared:  # by their ends; of those that end at a match's end or later, the earliest start decides
            ends = [b for _, b, _ in spared]
            starts = list(accumulate((a for a, _, _ in reversed(spared)), min))[::-1] + [math.inf]
            hits = [h for h in hits if starts[bisect_left(ends, h[1])] > h[0]]
        by_word: dict[int, float] = {}  # the heaviest entry of a word counts
        for begin, _, weight in hits:
            by_word[begin] = max(weight, by_word.get(begin, -math.inf))
        total = sum(by_word.values())
        return total, total / math.sqrt(folded.count(" ") or 1), len(by_word)

    def score(self, total: float, density: float) -> float:
        x = self.bias + self.total * math.log1p(total) + self.density * math.log1p(density)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x))))


def _entries(text: str) -> set[str]:
    found = set()
    for word in set(fold(text).split()):
        if word.isalpha():
            found.add(f" {word} ")
            found.update(f" {word[:n]}" for n in STEMS if len(word) > n)
    return found


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts by entry and kind, summed up per batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            for entry in _entries(text or ""):
                counts.setdefault(entry, [0, 0])[int(toxic)] += 1
        yield pd.DataFrame([(k, a, b) for k, (a, b) in counts.items()], columns=["entry", "other", "toxic"])


def _measure(lexicon: Lexicon):
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            rows = [lexicon.features(automaton, text or "") for text in batch.pop("text")]
            yield batch.assign(
                total=np.array([r[0] for r in rows], dtype=float),
                density=np.array([r[1] for r in rows], dtype=float),
                matches=np.array([r[2] for r in rows], dtype="int64"),
                score=np.array([lexicon.score(*r[:2]) for r in rows], dtype=float),
            )

    return measure


def measured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """`rows` with `text` replaced by total, density, matches and score."""
    schema = StructType([f for f in rows.schema.fields if f.name != "text"])
    for name in ("total", "density", "score"):
        schema = schema.add(name, "double")
    schema = schema.add("matches", "long")
    names = schema.fieldNames()
    ordered = _measure(lexicon)
    return rows.mapInPandas(lambda batches: (b[names] for b in ordered(batches)), schema)


def logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Bias and factors by Newton steps with a small quadratic penalty; both kinds weigh the same."""
    x = np.column_stack([np.ones(len(features)), features])
    weight = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        slope = x.T @ (weight * (p - labels)) + penalty * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, training: Column, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """Learn entries, weights and calibration from labelled documents that meet `training`.

    `docs` has doc_id and text, `labels` doc_id and toxic; null labels and ids are left out, and of
    several labels of a document the largest counts. The sample is bounded by SAMPLE_TOXIC and
    SAMPLE_OTHER and picked by a hash of the id; its ids are the only thing broadcast.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & training)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    picked = None
    for toxic, bound in ((1, SAMPLE_TOXIC), (0, SAMPLE_OTHER)):
        part = known.where(F.col("toxic") == toxic).orderBy("h", "doc_id").limit(bound)
        picked = part if picked is None else picked.union(part)
    chosen = picked.select("doc_id", "toxic")
    # an id may be repeated: each of its texts counts once
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.xxhash64("text"))
    sample = drawn.agg(F.first("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text")
    counted = (
        sample.mapInPandas(_count, "entry string, other long, toxic long")
        .groupBy("entry")
        .agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    )
    sizes = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon(exceptions=exceptions)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    best = (
        counted.where(F.col("toxic") >= MIN_TEXTS)
        .withColumn("odds", odds)
        .where(F.col("odds") >= MIN_ODDS)
        .orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "entry")
        .limit(LEXICON)
        .collect()
    )
    lexicon = Lexicon({r.entry: float(r.odds) for r in best}, exceptions)
    if not best:
        return lexicon
    rows = measured(sample, lexicon).select("toxic", "total", "density").toPandas()
    beta = logistic(np.log1p(rows[["total", "density"]].to_numpy()), rows["toxic"].to_numpy(dtype=float))
    lexicon.bias, lexicon.total, lexicon.density = (float(b) for b in beta)
    return lexicon


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, matches of every row.

    Learns only from labels of rows that are not held out. Null and empty texts have no matches and get
    the lowest score; repeated rows get equal scores. Without toxic labels, or in an empty table, every
    score is that of no match. Other columns are not read.
    """
    apart = held_out("doc_id", 3, 1)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    lexicon = fit(rows, labels.select("doc_id", "toxic"), ~apart)
    scored = measured(rows.withColumn("held_out", apart), lexicon)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "matches"
    )
