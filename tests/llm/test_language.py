"""Suffix automata and cross-parsing against a plain parse; held-out accuracy; edges."""

import random

from pyspark.sql import functions as F

from turfspark.llm import langid

LANGS = {"xx": "ba da ga lo mi ne pu", "yy": "sto kra vli zhu prem", "zz": "äo üe öi ßa äüs"}


def text(rng, lang, words=60):
    parts = LANGS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def plain_phrases(sample, codes):
    at, n = 0, 0
    while at < len(codes):
        size = 1
        while at + size < len(codes) and codes[at : at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


def test_automaton_has_exactly_the_substrings():
    rng = random.Random(1)
    word = [rng.randrange(3) for _ in range(40)]
    step = langid.suffix_automaton(word)
    subs = {tuple(word[i:j]) for i in range(40) for j in range(i, 41)}
    for _ in range(500):
        probe = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
        state = 0
        for c in probe:
            state = step[state].get(c) if state is not None else None
        assert (state is not None) == (tuple(probe) in subs)


def test_phrases_against_plain_parse(monkeypatch):
    rng = random.Random(2)
    samples = {k: text(rng, k, 200) for k in LANGS}
    parser = langid.Parser(samples)
    texts = [text(rng, rng.choice(list(LANGS)), rng.randrange(1, 30)) for _ in range(40)] + ["", "123 .. !", "日本語"]
    total, letters = parser.phrases(texts)
    for i, t in enumerate(texts):
        codes = parser.codes([t])[0].tobytes()
        assert letters[i] == sum(c.isalpha() for c in t)
        for k, lang in enumerate(parser.languages):
            sample = parser.codes([samples[lang]])[0].tobytes()
            pieces = [codes[a : a + langid.SEGMENT] for a in range(0, len(codes), langid.SEGMENT)]
            assert total[k, i] == sum(plain_phrases(sample, p) for p in pieces)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang), lang, 0.5) for i in range(300) for lang in [rng.choice(list(LANGS))]]
    rows += [(900, None, "xx", 0.1), (901, "", None, 0.1), (902, "42 + 1 = 43 !!", "yy", 0.1), (None, text(rng, "zz"), None, 0.1)]
    rows += [rows[0], (903, text(rng, "yy", 200_000), None, 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred double")
    found = langid.language_of(docs).collect()
    assert len(found) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    got = {r.doc_id: r for r in found}
    assert all(got[i].lang_pred == truth[i] for i in range(300) if got[i].held_out)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "yy" and got[None].lang_pred == "zz" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in found)


def test_language_that_is_mostly_one_copied_text(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 10)
    rng = random.Random(6)
    rows = [(i, text(rng, "xx"), "xx") for i in range(60)] + [(100 + i, text(rng, "yy"), "yy") for i in range(30)]
    copied = text(rng, "yy")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    copies = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(copied).alias("text"), F.lit("yy").alias("lang"))
    alone = langid.sample_texts(docs.union(copies.limit(1)), F.lit(True))
    assert langid.sample_texts(docs.union(copies), F.lit(True)) == alone and set(alone) == {"xx", "yy"}


def test_emoji_are_no_letters(spark):
    emoji = "\U0001f600\U0001f680 \U0001f4a9"
    rows = [(i, "ba da ga lo mi", "xx") for i in range(9)] + [(10, emoji, None), (11, "\U00010400\U00010401", None)]
    got = {r.doc_id: r for r in langid.language_of(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[10].lang_pred, got[10].score) == ("und", 0.0)
    assert got[11].lang_pred == "xx"  # letters, though of no script in the sample
    parser = langid.Parser({"xx": "ba da ga", "yy": "sto kra"})
    total, letters = parser.phrases(["ba da ga", f"ba {emoji} da ga"])
    assert letters.tolist() == [6, 6] and total[:, 0].tolist() == total[:, 1].tolist()


def test_no_languages_and_empty_table(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.language_of(spark.createDataFrame([], schema)).count() == 0
    rows = langid.language_of(spark.createDataFrame([(1, "abc", None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
    rows = langid.language_of(spark.createDataFrame([(i, "abc abd", "aa") for i in range(9)], schema)).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("aa", 1.0)}
