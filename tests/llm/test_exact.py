"""Radix partitioning against a plain grouping; components against a plain search."""

import hashlib
import random
import re

from turfspark.llm import common, exact


def test_against_grouping(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab \t\n") for _ in range(n)) for n in (0, 1, 5, 31, 32, 33, 40, 255, 256, 257, 2048, 2049, 20_000)]
    texts = [rng.choice(base) for _ in range(120)] + [b[:-1] + "c" for b in base if b] + [None, "", " ", "\n\t", "é" * 300, "é" * 300]
    ids = [*rng.sample(range(10_000), len(texts) - 2), None, 5]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, row int, n int")
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(k)
    want = []
    for body, members in groups.items():
        head = min(members, key=lambda k: (ids[k] is None, ids[k] or 0))
        digest = hashlib.sha256(body.encode()).hexdigest()
        want += [(ids[k], ids[head], len(members), k == head, digest) for k in members]
    got = [tuple(r) for r in exact.exact_duplicates(docs.repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert exact.exact_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = exact.exact_duplicates(spark.createDataFrame([(7, "x y")] * 3, schema)).collect()
    assert sorted(r.kept for r in rows) == [False, False, True] and {r.group_size for r in rows} == {3}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(500, 500)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + edges[:5]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent if any(i in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
