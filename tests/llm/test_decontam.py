"""Template windows against a plain search; slots; edges."""

import random

from turfspark.llm import decontam

ITEM = "How many apples does Anna have if she buys 12 kg in 3 days and gives 5 of them to Bert at noon"


def ids(spark, texts, items):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, matches int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.contaminated, r.item_ids, r.matched_tokens) for r in decontam.contamination(docs, bench).collect()}


def test_slots(spark):
    other = ITEM.replace("Anna", "Clara").replace("12", "40").replace("3", "7").replace("Bert", "Otto").replace("kg", "lbs")
    twice = "In this test we see 3 cats and 3 dogs run over 9 hills with no aim at all today"
    texts = [
        f"So: {ITEM}. Well.", f"So: {other}, ok", ITEM.upper(), twice.replace("3", "4"), twice.replace("3 dogs", "5 dogs"),
        "nothing of the kind at all, only words that come one after the other without end", None, "",
        " ".join(ITEM.split()[:12]), " ".join(ITEM.split()[:13]), "tiny item here",
    ]
    got = ids(spark, texts, [(7, ITEM), (8, twice), (None, "x"), (9, None), (10, "tiny item here"), (11, "one two three four five")])
    assert [i for i in sorted(got) if got[i][0]] == [0, 1, 2, 3, 9]
    assert got[0][1] == [7] and got[3][1] == [8] and got[9][2] == 13


def test_literal_copy_of_an_item_that_is_mostly_slots(spark):
    item = "Add 3 kg and 14 lbs to 15 oz 92 g 65 mg 35 kg 89 lbs 79 oz 32 g"
    texts = [f"see: {item}", f"see: {item.replace('92', '93').replace('65', '66')}", f"see: {item} {item}"]
    got = ids(spark, texts, [(1, item)])
    assert got[0] == (True, [1], 21) and got[2][0] and not got[1][0]


def test_consistent_stretch_beside_a_broken_slot(spark):
    words = [f"word{chr(97 + i)}" for i in range(26)]
    item = " ".join(["lead", "with", "3", *words[:7], "3", *words[7:26], "5", "end"])
    literal = item.replace(" 3 word", " 4 word", 1)  # 3 -> 4, 3 -> 3: the rest is equal
    changed = literal.replace("5 end", "6 end")
    apart = " ".join(["3", *words[:8], "3", *words[8:16], "3", *words[16:]])
    twice = " ".join(["4", *words[:8], "4", *words[8:16], "5", *words[16:20]])
    once = " ".join(["4", *words[:8], "5", *words[8:16], "4", *words[16:20]])
    got = ids(spark, [literal, changed, twice, once], [(1, item), (2, apart)])
    assert [got[i][1] for i in range(4)] == [[1], [1], [2], []]
    # by item 1: from behind the broken slot to the end
    assert got[0][2] == got[1][2] == 29


def test_stretches_against_plain_search():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randrange(4, 30)
        slot = [rng.random() < 0.5 for _ in range(n)]
        pairs = [(rng.randrange(3), rng.randrange(3)) if s else (9, 9) for s in slot]

        def fits(a, b):
            own = {pairs[i] for i in range(a, b) if slot[i]}
            return len({x for x, _ in own}) == len({y for _, y in own}) == len(own)

        ranges = [(a, b) for a in range(n) for b in range(a + 4, n + 1)]
        good = [r for r in ranges if fits(*r)]
        want = [r for r in good if not any(o != r and o[0] <= r[0] and o[1] >= r[1] for o in good)]
        assert sorted(decontam._one_to_one(pairs, slot, 4)) == want
        balance = [0]
        for s in slot:
            balance.append(balance[-1] + (-1 if s else 1))
        half = [(a, b) for a, b in ranges if balance[b] >= balance[a]]
        found = decontam._half_literal(balance, 0, n, 4)
        assert set(found) <= set(half) and max((b - a for a, b in found), default=0) == max((b - a for a, b in half), default=0)


def test_literal_passages_against_plain_search(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(20)]
    texts = []
    for _ in range(80):
        part = [word() for _ in range(rng.randrange(0, 60))]
        words = rng.choice(items)[1].split()
        cut = rng.randrange(0, len(words))
        part[len(part) // 2 : len(part) // 2] = words[cut : cut + rng.randrange(1, 30)]
        texts.append(" ".join(part))
    want = {}
    for i, t in enumerate(texts):
        words, hit = t.split(), set()
        for k, item in items:
            own = item.split()
            n = min(13, len(own))
            grams = {tuple(own[j : j + n]) for j in range(len(own) - n + 1)}
            if any(tuple(words[j : j + n]) in grams for j in range(len(words) - n + 1)):
                hit.add(k)
        want[i] = sorted(hit)
    got = ids(spark, texts, items)
    assert {i: v[1] for i, v in got.items()} == want


def test_blocks_give_the_same(spark, monkeypatch):
    items = [(i, f"item number {'x' * i} has these words and many more of them to be found in texts") for i in range(30)]
    texts = [t for _, t in items[::3]] + ["clean text"]
    want = ids(spark, texts, items)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 500)
    assert ids(spark, texts, items) == want


def test_clean_documents_keeps_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "fine", "b"), (None, None, None)], "doc_id long, text string, payload string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontam.clean_documents(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None}
    assert decontam.clean_documents(docs, bench.limit(0)).count() == 3
    assert decontam.clean_documents(docs.limit(0), bench).count() == 0
