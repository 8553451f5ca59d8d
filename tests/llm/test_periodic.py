"""Runs of repeated words against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from turfspark.llm import catalog, periodic


def brute(words, least):
    """(start, length, period) of all runs: for every period, the stretches in which words that far apart agree."""
    seen = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                seen.setdefault((start, i + q - start), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in seen.items())


def sequences(rng, count):
    fibonacci = [[0], [0, 1]]
    for _ in range(10):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for _ in range(count):
        kind, u = rng.randrange(6), [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        if kind == 0:
            yield [rng.randrange(rng.choice([1, 2, 4, 50])) for _ in range(rng.randrange(150))]
        elif kind == 1:
            yield (u * 20)[: rng.randrange(1, 220)]
        elif kind == 2:  # short periods inside a long one
            yield ([0, 1] * rng.randrange(1, 40) + [0] * rng.randrange(3)) * rng.randrange(1, 5) + u
        elif kind == 3:
            yield ([0] * rng.randrange(1, 60) + [1]) * rng.randrange(1, 5)
        elif kind == 4:
            yield u + fibonacci[rng.randrange(4, 12)] + u
        else:
            v = u[:3] * rng.randrange(2, 25)
            yield v + v[rng.randrange(3) :] + u + v + v


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_against_all_periods(spark):
    rng = random.Random(3)
    texts = [" \t\n\x0b"[rng.randrange(4)].join(f"é{x}" for x in w) for w in sequences(rng, 400)]
    texts += [None, "", " \r\n", "one", "    " * 8, "z" * 300_000, "ab " * 20_000]
    ids = [*range(len(texts) - 3), 5, 5, None]
    rows = [(t, i, "x", 1) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, runs string, n_words int")
    want = []
    for i, t in zip(ids, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(words, 12) if len(words) < 5000 else [(0, len(words), 1)]
        want.append((i, len(words), runs, collapsed(words, runs)))
    found = periodic.periodic_runs(docs.repartition(3)).collect()
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_neighbours_do_not_matter():
    """Laid end to end or alone, the same runs."""
    rng = random.Random(4)
    texts = [" ".join(map(str, w)).encode() for w in sequences(rng, 60)]
    together = [(n, r.tolist(), c) for n, r, c in periodic._described(texts, 12)]
    alone = [next((n, r.tolist(), c) for n, r, c in periodic._described([t], 12)) for t in texts]
    assert together == alone


def test_long_period_in_a_long_text():
    rng = np.random.default_rng(5)
    part = rng.integers(0, 10**6, 30_000).tolist()
    text = " ".join(map(str, [*part, *part, *part[:17], "end"])).encode()
    ((n, runs, kept),) = periodic._described([text], 12)
    assert n == 60_018 and runs.tolist() == [[0, 60_017, 30_000]]
    assert kept == " ".join(map(str, [*part, "end"])).encode()


def test_query(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(str(x) for x in w) for w in sequences(rng, 150)] + [None, ""]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in rows:
        words, h = (t or "").split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        runs = brute(words, 12)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * top[1] // top[2] if runs else None
        digests = ["".join("%d,%d,%d\n" % r for r in runs), collapsed(words, runs)]
        want.add((i, len(runs), *top, milli, *[hashlib.sha256(d.encode()).hexdigest() for d in digests]))
    found = catalog.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == want
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
