"""Feed files to tables, end to end, with bad lines and deletions."""

import json

import pytest

from turfspark.plans import rebuild
from turfspark.sources import feed, tables


def fixed(width, *parts):
    line = [" "] * width
    for start, value in parts:
        line[start : start + len(value)] = value
    return "".join(line)


KEY = "2024050105010203"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("feed")

    def write(name, records):
        lines = [r if isinstance(r, str) else json.dumps({"rec_id": r[0], "payload": r[1]}, ensure_ascii=False) for r in records]
        (path / f"{name}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")

    race = lambda distance, going: ("RA", fixed(890, (0, "RA1"), (11, KEY), (616, "13"), (634, "010"), (697, distance), (705, "24"), (873, "1510"), (883, "02"), (889, going)))
    runner = lambda no, horse, jockey, place="00": ("SE", fixed(555, (0, "SE7"), (11, KEY), (28, no), (30, horse), (296, jockey), (334, place), (338, "1234")))
    write("RACE_1", [race("0012", "0"), "", "{broken", race("1800", "2"), runner("01", "2020100001", "00007"), runner("01", "2020999999", "00008", "01"), ("ZZ", "x"),
                     ("HR", fixed(964, (11, KEY), (293, "0102" + "00000123" + "0001")))])
    write("DIFF_1", [("KS", fixed(80, (11, "00007"), (41, "Jockey"))), ("UM", fixed(100, (10, "2020100001"), (20, "Horse")))])
    forecast = lambda kbn, time: ("DM", fixed(303, (0, "DM" + kbn), (3, "20240501"), (11, KEY), (27, "0930"), (31, "01" + time), (46, "0211300")))
    write("0B13_1", [forecast("1", "11200"), forecast("0", "     ")])
    write("0B13_2", [forecast("1", "11250")])
    odds = ("O1", fixed(962, (0, "O14"), (11, KEY), (27, "05011430"), (43, "01002301"), (267, "010011002001")))
    write("0B41_ALL_20240501", [odds])
    write("0B41_ALL_20240401", [odds])
    write("OTHER_1", [odds])
    return str(path)


def test_files_are_chosen(spark, folder):
    names = [p.rsplit("/", 1)[-1] for p in feed.input_paths(spark, folder)]
    assert names == ["0B13_1.jsonl", "0B13_2.jsonl", "0B41_ALL_20240501.jsonl", "DIFF_1.jsonl", "RACE_1.jsonl"]
    assert any(p.endswith("20240401.jsonl") for p in feed.input_paths(spark, folder, o1_date="20240401"))
    with pytest.raises(FileNotFoundError):
        feed.input_paths(spark, folder, o1_date="19990101")


def test_bad_lines_are_kept_aside(spark, folder):
    bad = feed.quarantine(feed.read_feed(spark, feed.input_paths(spark, folder)))
    counts = {(r.file, r.reason): r.lines for r in feed.error_counts(bad).collect()}
    assert counts == {("RACE_1", "unreadable line"): 1, ("RACE_1", "other record type"): 1}
    assert feed.error_samples(bad, 1).count() == 1


def test_rebuild(spark, folder, tmp_path):
    records = feed.good(feed.read_feed(spark, feed.input_paths(spark, folder))).persist()
    built = rebuild.rebuild(records, "2024-01-01")
    race = built["race"].collect()
    assert [(r.race_id, r.surface, r.distance_m, r.going, r.start_time) for r in race] == [(202405010503, 2, 1200, 2, "15:10:00")]
    runner = built["runner"].collect()
    # the second record keeps the first horse id; its jockey is unknown
    assert [(r.horse_id, r.jockey_id, r.horse_no) for r in runner] == [("2020100001", None, 1)]
    assert [(r.horse_id, r.finish_pos, r.time_sec) for r in built["result"].collect()] == [("2020100001", 1, 83.4)]
    assert {(r.bet_type, r.selection, r.payout_yen) for r in built["payout"].collect()} == {(5, "0102", 1230)}
    live = {(r.horse_no, r.dm_time_x10, r.dm_rank) for r in built["rt_mining_dm"].collect()}
    assert live == {(1, 725, 1), (2, 730, 2)}
    assert [r.win_odds_x10 for r in built["o1_win"].collect()] == [23]
    assert [(r.min_odds_x10, r.max_odds_x10) for r in built["o1_place"].collect()] == [(11, 20)]
    pruned, counts = rebuild.prune_targets(built, "2024-01-01")
    assert {r.rows_deleted for r in counts.collect()} == {0} and pruned["payout"].count() == 1
    tables.write_tables({"race": built["race"], "result": built["result"]}, str(tmp_path))
    back = tables.read_tables(spark, str(tmp_path), ["race", "result"])
    assert back["race"].first().distance_m == 1200 and str(back["result"].first().time_sec) == "83.40"


def test_text_and_parquet_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("race_id,p\n1,0.5\n2,x\n")
    frame = tables.read_any(spark, str(tmp_path / "a.csv"), "race_id long, p double")
    assert [(r.race_id, r.p) for r in frame.collect()] == [(1, 0.5), (2, None)]
    tables.write_by_year(spark.sql("select 1L race_id, 2L horse_no, date'2024-05-01' race_date"), str(tmp_path / "f"))
    assert tables.read_any(spark, str(tmp_path / "f")).filter("year = 2024").count() == 1
