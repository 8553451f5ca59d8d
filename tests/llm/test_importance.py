"""Model against plain counts, exact top k, held-out separation, edges."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from turfspark.llm import importance


def corpus():
    rng = random.Random(6)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["buy", "now", "cheap", "alpha"]
    docs = [(i, " ".join(rng.choice(bad if i % 4 == 0 else good) for _ in range(rng.randrange(5, 60))), 1) for i in range(400)]
    labels = [(i, int(i % 4 != 0)) for i in range(0, 400, 3)]
    return docs, labels


def test_selection(spark):
    docs, labels = corpus()
    docs += [(1000, None, 1), (1001, "", 1), docs[7], docs[7], (None, "alpha beta", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, key int")
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    got = importance.resample(frame, known, share=0.6).collect()
    assert len(got) == len(docs) and sum(r.selected for r in got) == round(0.6 * len(docs))
    assert min(r.key for r in got if r.selected) >= max(r.key for r in got if not r.selected)
    ratio = {r.doc_id: r.log_ratio for r in got}
    apart = [i for i in range(400) if i % 3]
    wins = np.mean([ratio[a] < ratio[b] for a in apart if a % 4 == 0 for b in apart if b % 4])
    assert wins > 0.98 and ratio[1000] == ratio[1001] == 0.0
    again = importance.resample(frame.repartition(7), known, share=0.6).collect()
    assert sorted((r.doc_id or 0, r.key) for r in again) == sorted((r.doc_id or 0, r.key) for r in got)


def test_ratio_is_that_of_the_counts(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id long, text string")
    ratio = importance.log_ratios(rows, spark.createDataFrame([(1,)], "doc_id long"))
    size = importance.BUCKETS
    # raw: a 2, b 1, c 1, "a b" 1, "b a" 1, and "c" as the one pair of the second text
    low = math.log((1 / 7) * (5 + size) / (5 + size))
    assert len(ratio) == size and ratio.max() > 0 > ratio.min() and abs(low) > 0
    base = (1 + 1) / (7 + size)
    assert np.isclose(ratio.max(), math.log((2 + size * 3 / (7 + size)) / (5 + size)) - math.log(3 / (7 + size)))
    assert np.isclose(ratio.min(), math.log((size * base) / (5 + size)) - math.log(base))


def test_nth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.5, -3.0, 1e-300, 1e9]) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted(values, reverse=True)
    for n in (1, 2, 77, 250, 499, 500):
        value, above = importance.nth_largest(frame, "v", n)
        assert value == order[n - 1] and above == sum(v > value for v in values)
    assert importance.nth_largest(frame, "v", 0) is None and importance.nth_largest(frame, "v", 501) is None


def test_gumbel_and_empty_table(spark):
    noise = spark.range(20_000).select(importance.gumbel(F.col("id"), F.lit("x"), 1).alias("g")).toPandas()["g"]
    assert abs(noise.mean() - 0.5772) < 0.05 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.05
    schema, labels = "doc_id long, text string", spark.createDataFrame([], "doc_id long, quality int")
    assert importance.resample(spark.createDataFrame([], schema), labels).count() == 0
    rows = importance.resample(spark.createDataFrame([(1, "a")], schema), labels).collect()
    assert [(r.log_ratio, r.selected) for r in rows] == [(0.0, True)]
