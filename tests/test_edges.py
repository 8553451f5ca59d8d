"""Hand-computed answers for the rules that are easy to get wrong."""

import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from turfspark.functions import feed as R
from turfspark.functions import market as M
from turfspark.functions import scalars as S
from turfspark.operators import asof, calibrate, folds, history, ingroup, joins, merge, metrics, quality, ranking, wager
from turfspark.plans import registry


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_announcement_over_new_year(spark):
    race = dt.datetime(2024, 1, 5, 12, 0)
    df = spark.createDataFrame(
        [("12312350", race), ("01051130", race), ("02291000", race), ("99999999", race), (None, race)],
        "a string, r timestamp_ntz",
    )
    got = [r.x for r in df.select(S.announce_time(F.col("a"), F.col("r")).alias("x")).collect()]
    assert got == [dt.datetime(2023, 12, 31, 23, 50), dt.datetime(2024, 1, 5, 11, 30), dt.datetime(2024, 2, 29, 10, 0), None, None]


def test_feed_text_and_numbers(spark):
    assert one(spark, R.clean_int(F.col("v")), v=" 1２3a") == 123
    assert one(spark, R.clean_int(F.col("v")), v="abc") == 0
    assert one(spark, R.maskable_int(F.col("v")), v="12*4") is None
    assert one(spark, R.forecast_tenths(F.col("v")), v="99999") is None
    assert one(spark, R.forecast_tenths(F.col("v")), v="12345") == 834
    assert one(spark, R.run_seconds(F.col("v")), v="1234") == pytest.approx(83.4)
    assert one(spark, R.run_seconds(F.col("v")), v="12345") == pytest.approx(754.5)
    assert one(spark, R.race_id_date(F.col("v")), v=202402300101) is None


def test_kelly_guards(spark):
    assert one(spark, M.kelly(F.col("p"), F.col("o")), p=0.5, o=3.0) == pytest.approx(0.25)
    assert one(spark, M.kelly(F.col("p"), F.col("o")), p=0.5, o=1.0) == 0.0
    assert one(spark, M.kelly(F.col("p"), F.col("o")), p=1.0, o=3.0) == 0.0
    assert one(spark, M.floor_to_unit(F.col("v"), 100), v=999.9) == 900
    assert one(spark, S.round_report(F.col("v"), 1), v=0.25) == 0.2


def test_zscore_of_equal_values_and_ranks_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, None), (2, 1, 7.0)], "race_id long, horse_no long, v double")
    got = ingroup.add_rank(ingroup.add_zscores(df, {"v": "z"}), "v", rank="r", pct="p")
    rows = {(r.race_id, r.horse_no): (r.z, r.r, r.p) for r in got.collect()}
    assert rows == {(1, 1): (0.0, 1.5, 0.75), (1, 2): (0.0, 1.5, 0.75), (1, 3): (None, None, None), (2, 1): (0.0, 1.0, 1.0)}


def test_asof_picks_newest_before_each_cut(spark):
    day = dt.date(2024, 5, 1)
    rows = [(1, 1, 1, "05011130", 50), (1, 1, 2, "05011140", 40), (1, 1, 3, "05011140", 41), (1, 1, 4, "05011150", 30), (1, 1, 4, "05011201", 20), (1, 1, 4, "05011155", 0)]
    odds = spark.createDataFrame(rows, "race_id long, horse_no long, data_kbn long, announce_mmddhhmi string, win_odds_x10 long")
    race = spark.createDataFrame([(1, day, "12:00")], "race_id long, race_date date, start_time string")
    got = asof.win_snapshots(asof.with_post_time(odds, race)).first()
    assert (got.odds_win_t20, got.odds_win_t20_data_kbn) == (4.1, 3)
    assert (got.odds_win_t10, got.odds_win_final) == (3.0, 3.0)
    assert got.odds_win_t10_asof_dt == dt.datetime(2024, 5, 1, 11, 50)
    checked = asof.win_snapshots(asof.with_post_time(odds, race))
    pairs = [("odds_win_t10_announce_dt", "odds_win_t10_asof_dt")]
    assert quality.future_references(checked, pairs).isEmpty()


def test_tombstone_then_reinsert(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "c", 1)], "k int, v string, seq int")
    dead = spark.createDataFrame([(1, 2), (2, 5)], "k int, seq int")
    got = merge.last_write(merge.apply_tombstones(rows, dead, ["k"]), ["k"]).collect()
    assert [(r.k, r.v) for r in got] == [(1, "b")]


def test_zero_followed_by_unknown_is_unknown(spark):
    df = spark.createDataFrame([(1, 3, 1), (1, 0, 2), (1, None, 3), (2, 3, 1), (2, 0, 2)], "race_id int, going int, seq int")
    got = df.groupBy("race_id").agg(merge.last_known_or_reset("going").alias("g")).collect()
    assert {r.race_id: r.g for r in got} == {1: None, 2: 0}


def test_days_since_first_at_the_far_end(spark):
    base = dt.datetime(2020, 1, 1)
    rows = [("h", base, 1), ("h", base + dt.timedelta(days=730), 2), ("h", base + dt.timedelta(days=731), 3)]
    df = spark.createDataFrame(rows, "horse_id string, race_datetime timestamp_ntz, race_id int")
    got = {r.race_id: (r.prior_starts_2y, r.days_since_first_seen_2y) for r in history.add_experience(df).collect()}
    assert got == {1: (0, None), 2: (1, 730), 3: (1, 1)}


def test_exact_probabilities_against_brute_force(spark):
    import itertools
    from fractions import Fraction

    races = [[0.0], [1.0, 0.0], [1.0, 0.0, -1.0], [0.3, 0.1, -0.2, 1.4], [40.0, 20.0, 0.0, -1.0, -2.0], [0.5] * 6]
    rows = [(r, i + 1, s) for r, scores in enumerate(races) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "race_id long, horse_no long, s double")
    single = {(r.race_id, r.horse_no): r.p_top3 for r in ranking.top3_probabilities(df, "s").collect()}
    pair = {(r.race_id, r.horse_no_1, r.horse_no_2): r.p_wide for r in ranking.pair_probabilities(df, "s").collect()}
    want = {}
    for race, scores in enumerate(races):
        w = [Fraction(math.exp(s)) for s in scores]
        for order in itertools.permutations(range(len(w)), min(3, len(w))):
            prob, left = Fraction(1), sum(w)
            for i in order:
                prob *= w[i] / left
                left -= w[i]
            for size in (1, 2):
                for members in itertools.combinations(sorted(order), size):
                    key = (race, *[i + 1 for i in members])
                    want[key] = want.get(key, 0) + prob
    assert set(want) == set(single) | set(pair)
    for key, p in want.items():
        got = single[key] if len(key) == 2 else pair[key]
        assert got == pytest.approx(float(p), rel=1e-9, abs=1e-300)


def test_gumbel_agrees_with_exact(spark):
    df = spark.createDataFrame([(1, i + 1, 0.4 * i) for i in range(5)], "race_id long, horse_no long, s double")
    exact = {r.horse_no: r.p_top3 for r in ranking.top3_probabilities(df, "s").collect()}
    drawn = {r.horse_no: r.p_topk for r in ranking.gumbel_topk(df, "s", draws=4000).collect()}
    assert all(drawn[k] == pytest.approx(exact[k], abs=0.04) for k in exact)


def test_ranking_fit_reaches_zero_gradient(spark):
    rows = [(r, h, (h * 7 + r * 3) % 5 + 1, ((h * 11 + r) % 7) / 3.0, ((h + r * 5) % 4) / 2.0) for r in range(40) for h in range(1, 6)]
    df = spark.createDataFrame(rows, "race_id long, horse_no long, finish_pos long, a double, b double")
    weights, loss = ranking.fit_pl(df, ["a", "b"], l2=0.0, steps=12, tolerance=1e-12)
    scored = df.withColumn("s", ranking.linear_score(["a", "b"], weights))
    out = ranking.pl_gradient(scored, "s", ["a", "b"]).first()
    terms = ranking.pl_terms(ranking.finish_groups(scored), "s", gradient=True)
    both = terms.agg(F.sum("nll") / 40, F.sum(F.col("g") * F.col("a")) / 40).first()
    assert both[0] == pytest.approx(out.nll) and both[1] == pytest.approx(out.g_a, abs=1e-9)
    assert abs(out.g_a) < 1e-3 and abs(out.g_b) < 1e-3 and loss <= ranking.pl_nll(df.withColumn("s", F.lit(0.0)), "s").first().nll


def test_best_beta_has_the_least_loss(spark):
    rows = [(r, h, 1 if h == r % 4 + 1 else 0, 4, ((h * 5 + r) % 7) / 2.0) for r in range(30) for h in range(1, 5)]
    df = spark.createDataFrame(rows, "race_id long, horse_no long, y_win int, field_size int, s double")
    best = ranking.fit_beta(df, "s")
    loss = {r.beta: r.nll for r in ranking.beta_losses(df, "s", [best, best * 1.02, best / 1.02]).collect()}
    assert min(loss, key=loss.get) == best


def test_drawdown_over_days(spark):
    profits = [("2024-01-01", 1, 100), ("2024-01-01", 2, -250), ("2024-01-02", 3, -100), ("2024-01-02", 4, 400), ("2024-01-03", 5, -120)]
    df = spark.createDataFrame([(0, *p) for p in profits], "strategy_id int, race_date string, race_id long, profit long")
    assert wager.max_drawdown(df).first().max_drawdown == 350


def test_daily_cap_replay(spark):
    """Against a plain loop over the races of a day, with leftovers that later races still take."""
    rows = [(0, "2024-01-01", race, f"{k}", 1_000_000, 0.002, 100, 100, bet) for race, bets in {1: [900], 2: [700, 700, 600], 3: [100], 4: [500], 5: [100, 100]}.items() for k, bet in enumerate(bets)]
    df = spark.createDataFrame(rows, "strategy_id int, race_date string, race_id long, kumiban string, bankroll long, day_cap double, unit int, min_bet int, bet long")
    got = sorted((r.race_id, r.kumiban, r.bet) for r in wager.daily_cap(df).collect())
    want, left = [], 2000
    for race in range(1, 6):
        bets = [(r[3], r[8]) for r in rows if r[2] == race]
        total = sum(b for _, b in bets)
        if left > 0 and total > left:
            bets = [(k, int(b * (left / total) // 100) * 100) for k, b in bets]
        if left > 0:
            placed = [(race, k, b) for k, b in bets if b >= 100]
            want += placed
            left -= sum(b for _, _, b in placed)
    assert got == sorted(want)


def test_calibration_fit_and_holdout(spark):
    fit = spark.createDataFrame([(1, 1, 2, 0.35, 1), (1, 1, 3, 0.20, 1)], "race_id long, a int, b int, p_wide_raw double, y_wide int")
    late = spark.createDataFrame([(2, 1, 2, 0.40), (2, 1, 3, 0.10), (2, 2, 3, None)], "race_id long, a int, b int, p_wide_raw double")
    model, _, out = calibrate.fit_and_apply(fit, late)
    assert model.constant == 1.0 and sorted((r.p_wide for r in out.collect()), key=str) == [1.0, 1.0, None]
    rows = [(i / 50, int(i % 3 == 0 or i > 35)) for i in range(50)]
    train = spark.createDataFrame(rows, "p_wide_raw double, y_wide int")
    for method in calibrate.METHODS:
        fitted = calibrate.fit_calibrator(train, "p_wide_raw", "y_wide", method)
        got = [r.p_wide for r in calibrate.apply_calibrator(train, fitted).orderBy("p_wide_raw").collect()]
        assert got == sorted(got) and 0 <= got[0] <= got[-1] <= 1


def test_year_folds(spark):
    years = spark.createDataFrame([(y,) for y in range(2016, 2026)], "year int")
    valid = lambda frame: [v for _, _, v in folds.collect_folds(frame)]
    assert valid(folds.year_folds(years, 2025)) == list(range(2019, 2025))
    stacker = spark.createDataFrame([(y,) for y in range(2019, 2025)], "year int")
    assert valid(folds.stacker_folds(stacker, 2025)) == [2021, 2022, 2023, 2024]
    ranked = spark.createDataFrame([(y,) for y in range(2021, 2025)], "year int")
    assert valid(folds.year_folds(ranked, 2025)) == [2024]
    assert sorted(r.year for r in folds.recent_years(years, holdout_year=2025).collect()) == [2022, 2023, 2024]


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4)], "y int, p double")
    got = metrics.binary_metrics(df, "y", "p").first()
    assert got.auc is None and got.base_rate == 0.0


def test_checked_join_refuses_gaps(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError):
        joins.one_to_one(left, left.filter("k = 1").withColumn("v", F.lit(1)), ["k"])


def test_registry():
    assert len(registry.output_columns()) == 67 and len(registry.output_columns(with_te=True)) == 70
    assert registry.safe_encodings([*registry.output_columns(with_te=True), "p_target", "x_te"]) == [*registry.TARGET_ENCODING, "x_te"]
    columns = registry.binary_features([*registry.output_columns(), *registry.FINAL_ODDS])
    assert "odds_win_final" not in columns and "target_label" not in columns
    assert "odds_win_final" in registry.binary_features(registry.FINAL_ODDS, mode="includes_final")
    with pytest.raises(ValueError):
        registry.check(["a", "finish_pos"], mode="t10_only", stage="x")
    with pytest.raises(ValueError):
        registry.stacker_features(["a"], task="win")


def test_unsorted_file_is_found(spark, tmp_path):
    rows = [(1, 1), (1, 3), (1, 2), (2, 1)]
    spark.createDataFrame(rows, "race_id long, horse_no long").coalesce(1).write.parquet(str(tmp_path / "a"))
    assert [tuple(r) for r in quality.unsorted_rows(spark, str(tmp_path / "a")).collect()] == [(1, 2)]


def _plackett_luce(scores):
    """Top-3 and pair probabilities by adding up all orders of three, in logs."""
    def log_sum(values):
        high = max(values)
        return high + math.log(sum(math.exp(v - high) for v in values))

    n, one, two = len(scores), [0.0] * len(scores), {}
    for i, j, k in itertools.permutations(range(n), 3):
        left = [log_sum([s for x, s in enumerate(scores) if x not in gone]) for gone in ((), (i,), (i, j))]
        p = math.exp(scores[i] + scores[j] + scores[k] - sum(left))
        for x in (i, j, k):
            one[x] += p
        for x, y in itertools.combinations(sorted((i, j, k)), 2):
            two[x, y] = two.get((x, y), 0.0) + p
    return one, two


def test_scores_thousands_apart(spark):
    races = [[0, -400, -800, -1200, -1600], [0.0, 0.1, -0.2, 0.3], [5000, 4999, -5000, -5001, -4999.5, 0], [-3.0, -3.0, 700, 701, 2]]
    rows = [(r, i + 1, i + 1, float(s)) for r, scores in enumerate(races) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "race_id long, horse_no int, finish_pos int, s double")
    single = {(r.race_id, r.horse_no): r.p_top3 for r in ranking.top3_probabilities(df, "s").collect()}
    pair = {(r.race_id, r.horse_no_1, r.horse_no_2): r.p_wide for r in ranking.pair_probabilities(df, "s").collect()}
    for r, scores in enumerate(races):
        one, two = _plackett_luce([float(s) for s in scores])
        assert [single[r, i + 1] for i in range(len(scores))] == pytest.approx(one, abs=1e-9)
        assert all(pair[r, i + 1, j + 1] == pytest.approx(p, abs=1e-9) for (i, j), p in two.items())
    steep = df.filter("race_id = 0")
    assert ranking.pl_nll(steep, "s").first().nll == pytest.approx(0.0, abs=1e-9)
    terms = ranking.pl_terms(ranking.finish_groups(steep), "s", gradient=True).orderBy("horse_no").collect()
    assert [t.g for t in terms] == pytest.approx([0.0] * 5, abs=1e-9)


def test_more_runners_than_numbers_is_an_error(spark):
    df = spark.range(100).selectExpr("1L AS race_id", "int(id) AS horse_no", "int(id) + 1 AS finish_pos", "double(id) AS s")
    for frame in (ranking.pl_nll(df, "s"), ranking.pair_probabilities(df, "s")):
        with pytest.raises(Exception, match="more than 99 runners"):
            frame.collect()


def test_floor_of_chosen_bets_counts_inside_the_day(spark):
    """Day cap 20,000: the first race keeps 16,600 after the floor, so the second may take 3,400."""
    rules = (0, "2024-01-01", 1_000_000, 0.02, 100, 100, "selected", 0.1)
    bets = [(1, "a", 16_600, 0.2), (1, "b", 3_300, 0.05), (2, "a", 5_000, 0.3), (3, "a", 400, 0.3)]
    names = "strategy_id int, race_date string, bankroll long, day_cap double, unit int, min_bet int, min_p_stage string, min_p double"
    df = spark.createDataFrame([(*rules, *b) for b in bets], names + ", race_id long, kumiban string, bet long, p_wide double")
    assert sorted((r.race_id, r.kumiban, r.bet) for r in wager.daily_cap(df).collect()) == [(1, "a", 16_600), (2, "a", 3_400)]


def test_identity_follows_the_holder_of_a_number(spark):
    names = "race_id long, horse_no int, horse_id string, sex int, seq long"
    rows = [(1, 1, "A", 1, 1), (1, 2, "A", None, 2), (1, 1, "B", 2, 3), (1, 2, "C", 3, 4), (1, 3, "A", None, 5), (1, 2, "C", 9, 6)]
    merged = merge.merge_runner(spark.createDataFrame(rows, names))
    got = {(r.horse_id, r.horse_no, r.sex) for r in merged.collect()}
    # A takes 2 and frees 1 for B; record 4 is A's; A moves to 3, so C takes 2
    assert got == {("A", 3, 3), ("B", 1, 2), ("C", 2, 9)}


def test_stream_keeps_late_records(spark, tmp_path):
    """Four batches out of order, a first-seen key that comes late, a deletion, a repeated delivery."""
    from turfspark.streaming import odds

    names = "race_id long, horse_no int, value double, seq long, is_deleted boolean"
    batches = [[(1, 1, 5.0, 5, False)], [(1, 1, 9.0, 9, False), (3, 1, 1.0, 8, False)], [(2, 1, 2.0, 2, False), (1, 1, 5.0, 5, False)], [(3, 1, 1.0, 10, True), (3, 1, 7.0, 7, False)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(names).parquet(str(tmp_path / "in"))
        job = odds.current_snapshot(stream, str(tmp_path / "out"), ["race_id", "horse_no"], str(tmp_path / "state"))
        job.awaitTermination()
        assert job.lastProgress.batchId == i
    got = {(r.race_id, r.value) for r in odds.read_snapshot(spark, str(tmp_path / "out"), 3).collect()}
    assert got == {(1, 9.0), (2, 2.0)}


def test_drawn_top3_is_near_the_exact_one(spark):
    rows = [(r, i + 1, s) for r, scores in enumerate([[0.0, 0.5, 1.0, -0.3, 0.2], [2.0, 0.0], [0.0, -900.0, -1800.0, -2700.0]]) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "race_id long, horse_no int, s double")
    drawn = {(r.race_id, r.horse_no): r.p_topk for r in ranking.gumbel_topk(df, "s").collect()}
    exact = {(r.race_id, r.horse_no): r.p_top3 for r in ranking.top3_probabilities(df, "s").collect()}
    assert drawn.keys() == exact.keys()
    assert all(drawn[k] == pytest.approx(exact[k], abs=0.025) for k in exact)


def test_roles_by_name():
    roles = {"x_TE": "encoding", "te_id": "key", "odds_target": "odds", "p_target": "prediction", "te_date": "time", "anything": "other"}
    assert {c: registry.role_of(c) for c in roles} == roles
    assert registry.role_of(registry.ENTITY_IDS[0]) == "key"
