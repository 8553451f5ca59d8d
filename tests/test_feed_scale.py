"""Steps of the feed and of the draws whose cost must follow the rows."""

from __future__ import annotations

import gzip
import json
import time

import numpy as np
from pyspark.sql import functions as F

from turfspark.functions import feed as R
from turfspark.operators import ranking
from turfspark.sources import extract, feed


def _seconds(spark, text: str) -> float:
    column = F.concat(F.lit(text), F.substring(F.col("id").cast("string"), 1, 0))
    rows = spark.range(200_000).select(R.clean_int(column).alias("v"), R.maskable_int(column).alias("m"))
    start = time.perf_counter()
    rows.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def test_blank_number_costs_no_exception(spark):
    _seconds(spark, "12")
    assert _seconds(spark, "--") < 4 * _seconds(spark, "12") + 0.5


def test_numbers_of_byte_ranges(spark):
    texts = ["0012", " 7  ", "    ", "****", "-5  ", "1*2 ", "１２", "1 2 ", "+3.4"]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    kinds = ("int", "code", "mask", "some")
    item = lambda kind: extract.L.Field("v", 0, 4, kind)
    with extract.feed_charsets(spark):
        bytes_ = R.to_bytes(F.col("payload"), 4)
        rows = data.select("i", *[extract._value(bytes_, item(k)).alias(k) for k in kinds]).orderBy("i").collect()
    got = [tuple(r[k] for k in kinds) for r in rows]
    assert got == [
        (12, 12, 12, 12), (7, 7, 7, 7), (0, None, None, None), (0, None, None, None), (5, 5, 5, 5),
        (12, 12, None, 12), (12, 12, 12, 12), (12, 12, 12, 12), (34, 34, 34, 34),
    ]


def test_gzipped_feed(spark, tmp_path):
    for name, ids in (("RACE_2", ("RA", "XX")), ("0B41_ALL_20240501", ("O1",))):
        with gzip.open(tmp_path / f"{name}.jsonl.gz", "wt", encoding="utf-8") as out:
            out.writelines(json.dumps({"rec_id": i, "payload": "x"}) + "\n" for i in ids)
    (tmp_path / "RACE_1.jsonl").write_text('{"rec_id": "RA", "payload": "y"}\n', encoding="utf-8")
    records = feed.read_feed(spark, feed.input_paths(spark, str(tmp_path), o1_date="20240501"))
    found = {(r.file, r.rec_id, r.records) for r in feed.record_counts(records).collect()}
    assert found == {("RACE_1", "RA", 1), ("RACE_2", "RA", 1), ("RACE_2", None, 1), ("0B41_ALL_20240501", "O1", 1)}


def test_gumbel_counts_equal_sorting():
    seeds = np.random.default_rng(3)
    for scores in ([0.1, 2.0, -1.0, 0.3], [0.0] * 7, [900.0, 0.0, -5.0, 1.0, 2.0]):
        keys = [seeds.integers(0, 2**63, 2).astype(np.uint64) for _ in scores]
        noise = np.stack([np.random.Generator(np.random.Philox(key=k)).gumbel(size=2000) for k in keys])
        best = np.argsort(-(np.array(scores)[:, None] + noise), axis=0, kind="stable")[:3]
        wanted = np.bincount(best.ravel(), minlength=len(scores))
        assert ranking._topk_counts(np.array(scores), keys, 2000, 3).tolist() == wanted.tolist()


def test_small_races_are_not_drawn(spark):
    """Three runners are the first three of any draw, however many are asked for."""
    rows = spark.createDataFrame([(1, n, 0.5 * n) for n in (1, 2, 3)], "race_id bigint, horse_no int, score double")
    out = ranking.gumbel_topk(rows, "score", draws=10**13).collect()
    assert sorted((r.horse_no, r.p_topk) for r in out) == [(1, 1.0), (2, 1.0), (3, 1.0)]
