"""WARC writer and reader: round trip, revisits, nulls, rolling, determinism."""

import gzip
import hashlib
from pathlib import Path

from turfspark.llm import common, warc

BIG = "<p>" + "word " * 300 + "</p>"
ROWS = [
    (1, "http://a.example/x", BIG, 7), (2, "http://b.example/x", BIG, 7), (5, "http://a.example/y", BIG, 7),
    (3, None, "small", 7), (4, "http://c.example/", "small", 7), (6, "http://d.example/\r\n", None, 7),
    (7, "http://d.example/é", "é" * 600, 7), (None, "http://e.example/", BIG, 7), (8, "http://q.example/1", "x" * 999, 7),
    (9, "http://q.example/1", "x" * 999, 7),
]


def expected(rows):
    out = []
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None]
        last = max(same) if same else None
        revisit = len(payload) >= 1000 and page != last
        kind = "revisit" if revisit else "response"
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), kind, last if revisit else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, shard int")


def test_round_trip(spark):
    back = warc.round_trip(frame(spark, ROWS))
    got = [tuple(r) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == expected(ROWS)


def test_files_roll_and_are_the_same_each_time(spark):
    rows = [(i, f"http://h{i % 5}.example/{i}", f"<b>{i}</b>" * 50, 0) for i in range(200)]
    seen = []
    for parts in (1, 7):
        folder = common.scratch(spark)
        pages = frame(spark, rows).repartition(parts)
        listed = warc.write_warc(pages, folder, roll_bytes=4000, shard_bytes=20_000).collect()
        files = {p.name: p.read_bytes() for p in Path(folder.removeprefix("file://")).glob("*.warc.gz")}
        assert sorted(files) == sorted(r.final for r in listed) and len(files) > 4
        assert all(hashlib.sha256(files[r.final]).hexdigest() == r.sha256 for r in listed)
        assert sum(r.records for r in listed) == 200
        assert all(len(b) < 4000 + 1500 for b in files.values())
        seen.append(files)
    assert seen[0] == seen[1]
    assert gzip.decompress(next(iter(seen[0].values()))).startswith(b"WARC/1.1\r\n")


def test_repeated_rows_and_empty_table(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0
    back = warc.round_trip(frame(spark, [(1, "u", BIG, 0), (1, "u", BIG, 0)])).collect()
    assert [(r.page_id, r.record_type) for r in back] == [(1, "response")] * 2
