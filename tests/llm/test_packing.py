"""Best fit against a plain search; bins hold what they may; edges."""

import random

from pyspark.sql import functions as F

from turfspark.llm import packing


def plain(lengths, sources, clusters, capacity):
    bins, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [
            (b["left"], k) for k, b in enumerate(bins)
            if b["left"] >= lengths[i]
            and not (sources[i] is not None and sources[i] in b["sources"])
            and not (clusters[i] is not None and clusters[i] in b["clusters"])
        ]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        out[i] = (k, capacity - bins[k]["left"])
        bins[k]["left"] -= lengths[i]
        bins[k]["sources"].add(sources[i])
        bins[k]["clusters"].add(clusters[i])
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 60)
        lengths = [rng.randrange(1, 40) for _ in range(n)]
        sources = [rng.choice([None, "a", "a", "a", "b", "c", "d", "e"]) for _ in range(n)]
        clusters = [rng.choice([None, 1, 2, 3, *range(10, 60)]) for _ in range(n)]
        assert packing.best_fit(lengths, sources, clusters, 40) == plain(lengths, sources, clusters, 40)


def test_pack(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice((0, 3, 20, 64, 65, 150)))), rng.choice("aabc")) for i in range(300)]
    docs += [(900, None, "a"), (901, "  ", None), (None, "x y", None), (902, "x\ny", "q"), (1, docs[1][1], "b"), (1, docs[1][1], "b")]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, bin int")
    got = packing.pack(frame, capacity=64, group=50).collect()
    size = {}
    for doc, text, _ in docs:
        size[doc] = size.get(doc, 0) + len((text or "").split())
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert (r.bin is None) == (r.n_tokens == 0) and r.n_tokens <= 64
    assert total == size
    source = {d[0]: d[2] for d in docs if d[0] != 1}
    bins = {}
    for r in got:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.at)
        assert all(a.at + a.n_tokens == b.at for a, b in zip(rows, rows[1:], strict=False))
        assert rows[0].at == 0 and rows[-1].at + rows[-1].n_tokens <= 64
        named = [source[r.doc_id] for r in rows if source.get(r.doc_id)]
        assert len(named) == len(set(named))
        assert sum(r.doc_id == 1 for r in rows) <= 1
        assert not {None, 902} <= {r.doc_id for r in rows}


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_long_documents_in_late_partitions(spark):
    """Bins of whole pieces stay apart and in range, whatever the number of input partitions."""
    docs = spark.range(1100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 4100).alias("text"), F.lit("s").alias("source")).repartition(1100)
    rows = packing.pack(docs).collect()
    whole = [r.bin for r in rows if r.n_tokens == 2048]
    assert len(whole) == 2 * 1100 and len(set(whole)) == len(whole) and max(whole) < 0
