"""The pipeline, stage by stage, against the rules of each stage; edges; registration."""

import random
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_minhash import bag, jp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, payload string"


def corpus():
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    item = " ".join(word("abcdefg") for _ in range(30))
    shared = " ".join(word("abcdefg") for _ in range(12))
    docs = []
    for i in range(40):
        lang, letters = rng.choice([("aa", "abcdefg"), ("bb", "tuvwxyz")])
        lines = [" ".join(word(letters) for _ in range(40)) for _ in range(3)]
        if i % 8 == 0:
            lines.insert(1, shared)
        if i % 10 == 3:
            lines[0] = f"{lines[0]} {item}"
        docs.append((i, "\n".join(lines), lang, f"s{i % 3}", 0, "p"))
    words = docs[5][1].split()
    words[50] = "changed"
    docs.append((100, " ".join(words), docs[5][2], "s0", 0, "p"))  # a near copy without its line feeds
    docs.append((101, docs[6][1], docs[6][2], "s1", 0, "p"))  # an exact copy
    docs += [(102, None, None, None, None, None), (103, "12 !!", "aa", "s1", 0, "p"), (None, " ".join(word("abcdefg") for _ in range(9)), None, None, None, None)]
    return docs, item


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, item = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out, frame = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, folder).write.parquet(f"{folder}/stage{k}")
        frame = spark.read.parquet(f"{folder}/stage{k}")
        out.append(frame)
    return docs, item, out, folder


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns_stay(stages):
    for frame in stages[2][:-1]:
        assert frame.columns == [*COLUMNS, "payload"]


def test_each_stage(stages):
    docs, item, out, _ = stages
    first = {d[0]: d[1] for d in docs if re.search(r"[^\W\d_]", d[1] or "")}
    assert texts(out[0]) == first
    # lines: the first document with a line keeps it, here the one with the smallest id
    seen, second = set(), {}
    for i in sorted(first, key=lambda i: (i is None, i or 0)):
        kept = [s for s in first[i].split("\n") if len(s) < 20 or s not in seen]
        seen.update(first[i].split("\n"))
        if any(s.strip() for s in kept):
            second[i] = "\n".join(kept)
    assert texts(out[1]) == second and 101 not in second
    assert all(r.n_chars == len(r.text) for r in out[1].collect() if r.n_chars is not None)
    # near copies: none of those that stay is similar to another, and what went is similar to one that stays
    third, bags = texts(out[2]), {i: bag(t) for i, t in second.items()}
    for i in second:
        near = [k for k in second if k != i and jp(bags[i], bags[k]) >= 0.8]
        assert (i in third) == (not near or i == min([i, *near])) and third.get(i, second[i]) == second[i]
    assert 100 not in third and 5 in third
    fourth = {i: t for i, t in third.items() if item not in t.replace("\n", " ")}
    assert texts(out[3]) == fourth and len(fourth) < len(third)
    sizes = {}
    for r in out[4].collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
    assert sizes == {i: len(t.split()) for i, t in fourth.items()}


def test_run_gives_the_last_stage(spark, stages):
    _, _, out, folder = stages
    got = corpus_pipeline.run(spark, folder).select("doc_id", "piece", "n_tokens").collect()
    assert sorted(got, key=str) == sorted(out[4].select("doc_id", "piece", "n_tokens").collect(), key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
