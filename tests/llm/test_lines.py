"""Line join: edit distance, segments, classes against brute force, edges."""

import random

import pytest

from turfspark.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, what = rng.randrange(len(out) + 1), rng.randrange(3)
        if what == 0:
            out.insert(at, rng.choice("abcé"))
        elif out and at < len(out):
            out[at : at + 1] = [] if what == 1 else [rng.choice("abcé")]
    return "".join(out)


@pytest.mark.parametrize("tau", [1, 2, 3, 5])
def test_edit_distance(tau):
    rng = random.Random(tau)
    left = ["".join(rng.choice("abcé") for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    right = [edited(rng, t, rng.randrange(0, tau + 3)) for t in left]
    got = lines.edit_distances(left, right, tau)
    assert got.tolist() == [min(distance(a, b), tau + 1) for a, b in zip(left, right, strict=True)]


def brute(docs, tau):
    """doc order -> (lines, removed, links, text), by comparing all lines."""
    items = [(i, p, s) for i, (_, t) in enumerate(docs) for p, s in enumerate((t or "").split("\n")) if len(s) >= lines.SHORT]
    kinds = sorted({s for _, _, s in items})
    parent = {s: s for s in kinds}
    degree = dict.fromkeys(kinds, 0)

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if min(len(a), len(b)) >= lines.FUZZY and abs(len(a) - len(b)) <= tau and distance(a, b) <= tau:
                parent[root(b)] = root(a)
                degree[a] += 1
                degree[b] += 1
    seen, gone = set(), set()
    for i, p, s in sorted(items, key=lambda x: (docs[x[0]][0] is None, docs[x[0]][0] or 0, x[0], x[1])):
        gone |= {(i, p)} if root(s) in seen else set()
        seen.add(root(s))
    out = []
    for i, (doc, t) in enumerate(docs):
        parts = (t or "").split("\n")
        kept = [s for p, s in enumerate(parts) if (i, p) not in gone]
        removed = len(parts) - len(kept)
        links = sum(degree[s] for s in parts if len(s) >= lines.SHORT)
        out.append((doc, len(parts) if t else 0, removed, links, "\n".join(kept)))
    return out


@pytest.mark.parametrize("tau", [1, 2])
def test_against_brute_force(spark, tau):
    rng = random.Random(40 + tau)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice((10, 25, 31, 45, 80)))) for _ in range(25)]
    docs = []
    for i in range(60):
        docs.append((i, "\n".join(edited(rng, rng.choice(base), rng.choice((0, 0, 1, 2))) for _ in range(rng.randrange(1, 6)))))
    docs += [(60, None), (61, ""), (None, docs[0][1]), (62, "\n\n" + base[3] + "\n"), (63, "same " * 9)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, line string")
    got = lines.line_duplicates(frame, tau=tau).drop("row").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, tau), key=str)


def test_defaults_link_two_edits_short_lines_and_short_copies(spark):
    long = "All rights reserved by the owner of these pages. " * 10
    texts = [
        long + "2021", long + "2034", "Page printed on 12 May", "Page printed on 30 May", "Contact us", "Contact us", "Contact it",
        "\n\n",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in lines.line_duplicates(docs).collect()}
    assert [got[i] for i in range(8)] == [0, 1, 0, 1, 0, 1, 0, 0]


def test_passes_give_the_same(spark, monkeypatch):
    rng = random.Random(77)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(40)) for _ in range(10)]
    docs = spark.createDataFrame([(i, edited(rng, rng.choice(base), i % 3)) for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(lines, "PASSES", 1)
    want = sorted(map(tuple, lines.line_duplicates(docs).collect()))
    monkeypatch.setattr(lines, "PASSES", 3)
    assert sorted(map(tuple, lines.line_duplicates(docs).collect())) == want


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert lines.line_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = lines.line_duplicates(spark.createDataFrame([(1, "one line that is long enough")] * 2, schema)).collect()
    assert sorted(r.n_removed for r in rows) == [0, 1]


def test_classes_without_degrees_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice((19, 20, 22, 33, 60)))) for _ in range(12)]
    texts = ["\n".join(edited(rng, rng.choice(base), rng.randrange(4)) for _ in range(3)) for _ in range(30)]
    # a hot segment: lines that share their first half, alike in groups
    texts += ["the same beginning of every line " + format(i % 12, "06b") * 3 for i in range(24)]
    docs = [*enumerate(texts), (None, texts[0]), (7, texts[7]), (99, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = lines.line_duplicates(frame, degrees=False).select("doc_id", "n_lines", "n_removed", "text").collect()
    want = [(d, n, removed, text) for d, n, removed, _, text in brute(docs, lines.TAU)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_hot_group_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh") for _ in range(60))
    variants = sorted({edited(rng, base, 2) for _ in range(300)})
    compared = []
    verified = lines._verified

    def counted(pairs, bodies, tau):
        compared.append(pairs.count())
        return verified(pairs, bodies, tau)

    monkeypatch.setattr(lines, "_verified", counted)
    docs = [(i, v) for i, v in enumerate([base, *variants])]
    got = lines.line_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), degrees=False).collect()
    assert sum(r.n_removed for r in got) == len(docs) - 1
    assert sum(compared) < 30 * len(docs)  # all pairs would be 150 each


@pytest.mark.parametrize("tau", [0, 1, 2, 3])
def test_two_segments_of_alike_lines_are_probed(tau):
    rng = random.Random(60 + tau)

    def keys(text, probe):
        batch = lines.pa.record_batch([lines.pa.array([text])], names=["body"])
        (out,) = lines._keys(tau, probe, 0, 1, pairs=True, letters=False)(iter([batch]))
        return set(out.column("key").to_pylist())

    for _ in range(400):
        a = "".join(rng.choice("abcdefé ") for _ in range(rng.randrange(lines.FUZZY, 50)))
        b = edited(rng, a, tau)
        if len(b) >= lines.FUZZY:
            short, long = sorted((a, b), key=len)
            assert keys(short, False) & keys(long, True)
            assert keys(long, False) <= keys(long, True)


def test_lines_that_share_a_segment_by_chance_are_not_compared(spark, monkeypatch):
    rng = random.Random(9)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    texts = ["a segment in every line, " + "".join(rng.sample(letters, 27)) + "".join(rng.sample(letters, 27)) for _ in range(200)]
    compared = []
    verified = lines._verified

    def counted(pairs, bodies, tau):
        compared.append(pairs.count())
        return verified(pairs, bodies, tau)

    monkeypatch.setattr(lines, "_verified", counted)
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + "!"])), "doc_id long, text string")
    got = lines.line_duplicates(docs, degrees=False).collect()
    assert [r.doc_id for r in got if r.n_removed] == [200]
    assert sum(compared) < 200  # all pairs would be 20,000, whose letters agree


def test_many_unlinked_copies_take_few_rounds(spark, monkeypatch):
    rng = random.Random(10)
    base = [rng.choice("abcdefgh") for _ in range(90)]
    rounds = []
    verified = lines._verified

    def counted(pairs, bodies, tau):
        rounds.append(1)
        return verified(pairs, bodies, tau)

    def variant(i):
        own = list(base)
        for at in rng.sample(range(90), 2):
            own[at], own[(at + 45) % 90] = own[(at + 45) % 90], own[at]
        return "".join(own) + ("" if i % 10 else "x")

    monkeypatch.setattr(lines, "_verified", counted)
    docs = [(i, variant(i)) for i in range(150)]
    docs += [(1000 + i, t[:30] + "z" + t[30:]) for i, t in docs[:40]]
    got = lines.line_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), degrees=False)
    found = got.select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, found)) == sorted((d, n, removed, text) for d, n, removed, _, text in brute(docs, lines.TAU))
    assert len(rounds) <= 3


def test_long_line_beside_short_ones():
    rng = random.Random(2)
    long = "".join(rng.choice("abcd") for _ in range(5_000))
    left = ["a line of usual length, no. " + str(i) for i in range(3000)] + [long]
    right = [t + "x" for t in left[:-1]] + [long[:70] + long[71:]]
    pairs = lines.pa.record_batch(
        [lines.pa.array(range(3001)), lines.pa.array(range(3001)), lines.pa.array(left), lines.pa.array(right)],
        names=["a", "b", "body_a", "body_b"],
    )
    import tracemalloc

    tracemalloc.start()
    (out,) = lines._verify(2)(iter([pairs]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(out.column("edits").to_pylist()) == {1}
    assert peak < 60 << 20  # padded to the longest line it would be 120 MB
