"""Folding, exception phrases, held-out accuracy, edges."""

import random
import time

from pyspark.sql import functions as F

from turfspark.llm import toxicity


def test_fold():
    assert toxicity.fold("1D10T, мorоn!") == " idiot moron "
    assert toxicity.fold("") == "  "


def test_exceptions_and_word_starts():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " lowe": 2.0})
    found = lexicon.automaton()
    assert lexicon.features(found, "The trash can. Trash!")[2] == 1
    assert lexicon.features(found, "trash bin")[2] == 0
    assert lexicon.features(found, "Loweia, slowe lowexyz")[2] == 2
    assert lexicon.features(found, "")[0] == 0.0


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randrange(20, 200))]
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["zorg", "Z0RG", "kwalix", "kwalor"]))
        docs.append((i, " ".join(words), 9))
        labels.append((i, int(toxic)))
    docs += [(1000, None, 9), (1001, "", 9), (None, "abc", 9), docs[5], (1002, "abcde " * 100_000 + "zorg zorg zorg zorg", 9)]
    labels += [(None, 1), (3, None), (5, 1)]
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus()
    got = toxicity.toxicity(
        spark.createDataFrame(docs, "doc_id long, text string, score int"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    ).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    wrong = [i for i in range(600) if by_id[i].held_out and by_id[i].predicted != (i % 5 == 0)]
    assert len(wrong) <= 2
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert by_id[1000].predicted == by_id[1001].predicted == 0 and not by_id[None].held_out
    assert by_id[1002].matches == 4


def test_no_labels_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.toxicity(docs, empty).collect()] == [0]
    assert toxicity.toxicity(docs.limit(0), empty).count() == 0


def test_exceptions_in_a_very_long_text():
    """Matches and exception phrases by the hundred thousand: the same choice as by hand, in time in proportion."""
    lexicon = toxicity.Lexicon({" trash ": 3.0, " can ": 1.0, " lowe": 2.0}, ("trash can", "can do it"))
    found = lexicon.automaton()
    rng = random.Random(7)

    def plain(text):
        folded, spans, hits = toxicity.fold(text), [], set()
        for phrase in map(toxicity.fold, lexicon.exceptions):
            spans += [(k, k + len(phrase)) for k in range(len(folded)) if folded.startswith(phrase, k)]
        for entry in lexicon.weights:
            for k in range(len(folded)):
                if folded.startswith(entry, k) and not any(a <= k and k + len(entry) <= b for a, b in spans):
                    hits.add(k)
        return len(hits)

    for _ in range(200):
        text = " ".join(rng.choice(["trash", "can", "do", "it", "lowe", "x"]) for _ in range(rng.randrange(30)))
        assert lexicon.features(found, text)[2] == plain(text)
    started = time.time()
    assert lexicon.features(found, "trash can " * 300_000 + "trash")[2] == 1
    assert time.time() - started < 30


def test_repeated_ids_count_once(spark):
    docs, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    once, again = (
        toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, n int"), marks, F.lit(True))
        for rows in (docs, docs + docs[:50] * 40)
    )
    assert once.weights == again.weights and abs(once.bias - again.bias) < 1e-6
