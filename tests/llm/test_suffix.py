"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from turfspark.llm import suffix


def brute(docs):
    """Of each (doc_id, text): n_bytes, n_removed, n_spans, sha256 of the rest."""
    n = suffix.LENGTH
    least = {}
    for doc, text in docs:
        raw, order = (text or "").encode(), float("inf") if doc is None else doc
        for p in range(len(raw) - n + 1):
            least[raw[p : p + n]] = min(order, least.get(raw[p : p + n], order))
    out = []
    for doc, text in docs:
        raw, order = (text or "").encode(), float("inf") if doc is None else doc
        gone = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            if least[raw[p : p + n]] < order:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.choice((30, 48, 49, 50, 51, 70, 140))) for _ in range(8)] + ["ab" * 60, "z" * 90]
    docs = []
    for i in rng.sample(range(1000), 70):
        parts = [rng.choice([text(rng.randrange(0, 80)), rng.choice(passages)]) for _ in range(rng.randrange(1, 7))]
        docs.append((i, "".join(parts)))
    docs += [(2000 + i, docs[i][1][: rng.randrange(1, 200)] + "x" + docs[i][1][40:]) for i in range(20)]
    docs += [(3000, docs[3][1]), (3001, docs[3][1]), (None, docs[3][1]), (None, passages[6]), (5, None), (6, ""), (7, "é" * 30)]
    docs += [(3000, docs[4][1]), (3000, docs[4][1])]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    docs = corpus(seed)
    schema = "doc_id long, text string, block int, ids string"
    for parts in (1, 7):
        frame = spark.createDataFrame([(*d, 1, "a") for d in docs], schema).repartition(parts)
        got = [tuple(r) for r in suffix.repeated_strings(frame).collect()]
        assert sorted(got, key=str) == sorted(brute(docs), key=str)


def test_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 1000)
    docs = corpus(3)
    got = [tuple(r) for r in suffix.repeated_strings(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)


def test_multikey_sort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    groups = rng.integers(0, 3, 500)
    order, equal = suffix.multikey(words, groups)
    rows = [(groups[i], *words[i]) for i in order]
    assert rows == sorted(rows)
    assert [a == b for a, b in zip(rows, rows[1:], strict=False)] == (equal[1:] == equal[:-1]).tolist()


def test_empty_table(spark):
    assert suffix.repeated_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
