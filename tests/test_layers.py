"""The model layers on small races: early stopping, median rounds, temperatures, ranking folds, second layers, trials."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turfspark.operators import folds, ranking, selection, train
from turfspark.plans import registry

SCHEMA = (
    "race_id long, horse_no int, year int, field_size int, finish_pos int, y_win int, y_place int, is_3yo int, a double, b double, c double"
)


def races(n=240, years=(2014, 2015, 2016, 2017, 2018), seed=1):
    rng = random.Random(seed)
    rows = []
    for race in range(n):
        field = rng.randrange(2, 8)
        values = [(rng.gauss(0, 1), rng.gauss(0, 1), None if rng.random() < 0.2 else rng.gauss(0, 1)) for _ in range(field)]
        shown = sorted(range(field), key=lambda k: -(values[k][0] - 0.5 * values[k][1] + rng.gauss(0, 1)))
        for k in range(field):
            place = shown.index(k) + 1
            rows.append((race, k + 1, years[race % len(years)], field, place, int(place == 1), int(place <= 3), race % 2, *values[k]))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(races(), SCHEMA).persist()


def test_boosting_stops_at_the_best_round(spark, frame):
    """The model keeps the rounds up to the least loss of the held-back races; the next round's loss is no lower."""
    early = train.fit_binary(frame, "gbt", ["a", "b", "c"], "y_win", {"rounds": 12, "depth": 3, "rate": 0.3}, stop_early=True)
    full = train.fit_binary(
        frame.filter(~train.held_races()), "gbt", ["a", "b", "c"], "y_win", {"rounds": 12, "depth": 3, "rate": 0.3}
    )
    rounds = train.best_round(early)
    assert train.best_round(full) == 12 and 1 <= rounds < 12
    held = early.transform(train.numeric_inputs(frame.filter(train.held_races()), ["a", "b", "c"]))
    kept = held.drop("rawPrediction", "probability", "prediction")
    losses = early.stages[-1].evaluateEachIteration(kept)
    assert losses == sorted(losses, reverse=True) and len(losses) == rounds
    parts = [frame.select("race_id", train.held_races().alias("h")).distinct().groupBy("race_id").count().agg(F.max("count")).first()[0]]
    assert parts == [1]  # a race is on one side


def test_no_race_held_back(spark):
    rows = [r for r in races(40) if r[0] < 3]
    model = train.fit_binary(
        spark.createDataFrame(rows, SCHEMA), "gbt", ["a", "b"], "y_win", {"rounds": 3, "held": 0.0}, stop_early=True
    )
    assert train.best_round(model) == 3


@pytest.mark.parametrize("rounds, nearest, want", [
    ([3, 9, 4], False, 4), ([3, 4], False, 3), ([3, 4], True, 4), ([2, 3], True, 2), ([50, 60], False, 20), ([None, None], False, 20), ([0], False, 1),
])
def test_median_rounds(spark, rounds, nearest, want):
    table = spark.createDataFrame([(r,) for r in rounds], "best_round int")
    assert train.final_rounds(table, 20, nearest=nearest) == want


def test_folds_train_on_earlier_years_only(spark, frame):
    oof = train.fold_predictions(
        frame, folds.year_folds(folds.years_of(frame, "year"), 2018), "logistic", ["a", "b"], "y_win", "p", train_rows=True
    ).persist()
    sides = {(r.fold_id, r.valid_year, r.role): r.n for r in oof.groupBy("fold_id", "valid_year", "role").agg(F.count("*").alias("n")).collect()}
    years = {y: n for y, n in frame.groupBy("year").count().collect()}
    assert sides == {(1, 2017, "valid"): years[2017], (1, 2017, "train"): years[2014] + years[2015] + years[2016]}


def test_temperatures_by_fold(spark):
    """Every fold's temperature against a fine search; a fold without a usable race has 1."""
    rng = random.Random(3)
    rows = []
    for fold in (1, 2, 3):
        for race in range(80):
            scores = [rng.gauss(0, 2) for _ in range(4)]
            weights = [math.exp((0.3, 1.5, 1.0)[fold - 1] * s) for s in scores]
            winner = rng.choices(range(4), weights)[0] if fold < 3 else None
            rows += [(fold, race, s, int(k == winner), 4) for k, s in enumerate(scores)]
    frame = spark.createDataFrame(rows, "fold_id int, race_id long, s double, y_win int, field_size int")
    found = ranking.fit_betas(frame, "s", "fold_id")
    assert found[3] == 1.0

    def loss(fold, beta):
        total = 0.0
        for race in range(80):
            own = [r for r in rows if r[0] == fold and r[1] == race]
            total += math.log(sum(math.exp(beta * r[2]) for r in own)) - beta * sum(r[2] for r in own if r[3])
        return total

    for fold in (1, 2):
        best = min(np.geomspace(0.1, 10, 400), key=lambda b: loss(fold, b))
        assert loss(fold, found[fold]) <= loss(fold, best) + 1e-6
    late = ranking.add_win_scores_by(
        frame.withColumn("p", 1 / (1 + F.exp(-F.col("s")))), "p", {k: v for k, v in found.items()}, "fold_id"
    )
    sums = late.groupBy("fold_id", "race_id").agg(F.sum("c_p_betahat").alias("s"))
    # races repeat between folds here, so sums are over all three
    assert {round(r.s, 9) <= 1 for r in sums.collect()} == {True}


def test_grouped_ranking_fit_equals_single_fits(spark, frame):
    names = ["a", "b", "c"]
    members = frame.filter("year < 2018").withColumn("fold_id", F.explode(F.array(F.lit(1), F.lit(2))))
    members = members.filter("fold_id = 1 or year > 2014").persist()
    stats = {r.fold_id: {} for r in members.select("fold_id").distinct().collect()}
    for r in ranking.feature_stats_by(members, names, "fold_id").collect():
        stats[r.fold_id][r.feature] = r
    rows = {k: [own[n] for n in names] for k, own in stats.items()}
    together = ranking.fit_pl_by(ranking.standardize_by(members, rows, "fold_id"), names, "fold_id")
    for fold in (1, 2):
        own = members.filter(F.col("fold_id") == fold)
        single = ranking.feature_stats(own, names)
        for at, n in enumerate(names):
            assert np.allclose([rows[fold][at][f] for f in ("median", "mean", "std")], single[n])
        weights, loss = ranking.fit_pl(ranking.standardize(own, single), names)
        assert np.allclose(together[fold][0], weights, atol=1e-6) and abs(together[fold][1] - loss) < 1e-9 and together[fold][2]


def test_model_table_round_trip(spark, frame, tmp_path):
    names = ["a", "b", "c"]
    model = train.fit_ranking_recent(frame, names, holdout_year=2018)
    model.write.parquet(f"{tmp_path}/model")
    found = train.rank_holdout_with(frame, spark.read.parquet(f"{tmp_path}/model"), holdout_year=2018)
    late = frame.filter("year >= 2018")
    rows = {r.feature: r for r in model.collect()}
    want = {}
    for r in late.collect():
        x = {n: r[n] if r[n] is not None else rows[n].median for n in names}
        want[r.race_id, r.horse_no] = sum(rows[n].weight * (x[n] - rows[n]["mean"]) / rows[n].std for n in names)
    got = {(r.race_id, r.horse_no): r for r in found.horses.collect()}
    assert set(got) == set(want) and all(abs(got[k].pl_score - v) < 1e-9 for k, v in want.items())
    pairs = found.pairs.collect()
    assert len(pairs) == sum(n * (n - 1) // 2 for (n,) in late.groupBy("race_id").count().select("count").collect())
    assert all(abs(p.p_top3_1 - got[p.race_id, p.horse_no_1].p_top3) < 1e-12 for p in pairs)
    one = found.metrics.first()
    assert one.rows == len(want) and one.valid_year == 2018 and one.pl_nll > 0
    assert {r.segment for r in found.segments.collect()} == {"all", "3yo", "4up"}
    with pytest.raises(Exception, match="no model for"):
        ranking.score_by(late.withColumn("fold_id", F.lit(7)), model, "fold_id").collect()


def test_second_layer_by_contract(spark, frame):
    keys = frame.filter("year < 2018").select("race_id", "horse_no")
    oofs = {f"p_win_{n}": keys.withColumn(f"p_win_{n}", F.lit(0.2) + F.rand(k) / 2) for k, n in enumerate(registry.LEARNERS)}
    context = {c: F.lit(1.0) + F.col("a") for c in [*registry.STACKER_ODDS["win"], *registry.STACKER_CONTEXT] if c not in frame.columns}
    rows = frame.withColumns(context)
    found = train.stack_task(rows, oofs, "win", "y_win", holdout_year=2018, name="logistic", params={"rounds": 5})
    assert found.columns[:3] == list(oofs) and found.rows.count() == keys.count()
    assert {(r.fold_id, r.valid_year) for r in found.oof.select("fold_id", "valid_year").distinct().collect()} == {(1, 2016), (2, 2017)}
    twice = {**oofs, "p_win_gbt": oofs["p_win_gbt"].unionByName(oofs["p_win_gbt"].limit(1))}
    with pytest.raises(ValueError, match="repeated"):
        train.stack_task(rows, twice, "win", "y_win", holdout_year=2018)
    with pytest.raises(ValueError, match="missing columns"):
        train.stack_task(rows.drop("weather"), oofs, "win", "y_win", holdout_year=2018)
    with pytest.raises(ValueError, match="no row before"):
        train.stack_task(rows.filter("year >= 2018"), oofs, "win", "y_win", holdout_year=2018)


def test_trials_end_in_a_choice(spark, frame):
    fold_frame = folds.year_folds(folds.years_of(frame, "year"), 2018)
    grid = [{"penalty": 10.0, "rounds": 20}, {"penalty": 1e-3, "rounds": 20}]
    trials = train.search_trials(frame, fold_frame, "logistic", ["a", "b"], "y_win", grid, y_win="y_win").persist()
    rows = {r.trial: r for r in trials.collect()}
    assert rows[1].mean_logloss < rows[0].mean_logloss and rows[0].state == "COMPLETE" and rows[1].r2_median > rows[0].r2_median
    best = selection.best_trial(trials, task="win", baseline_median=rows[0].r2_median, baseline_min=rows[0].r2_min).first()
    assert (best.trial, best.rule, best.params) == (1, "constrained_logloss", "[('penalty', 0.001), ('rounds', 20)]")


def test_medians_and_moments_are_found_once_per_fold(spark, monkeypatch):
    """Parameter sets of a search share the preparation of a fold, and fit what each would fit alone."""
    rows = [(r, h, 3, 2015 + r % 5, float((r * 7 + h * 3) % 11), None if r % 6 == 0 else float(h * r % 5), int(h == r % 3 + 1)) for r in range(60) for h in (1, 2, 3)]
    frame = spark.createDataFrame(rows, "race_id long, horse_no int, field_size int, year int, a double, b double, y_win int").persist()
    fold_frame = folds.year_folds(folds.years_of(frame, "year"), 2020, least=3)
    seen, fit = [], train.Imputer._fit
    monkeypatch.setattr(train.Imputer, "_fit", lambda self, df: seen.append(1) or fit(self, df))
    grid = [{"penalty": 1e-3}, {"penalty": 1e-1}, {"penalty": 1.0}]
    trials = {r.trial: r.mean_logloss for r in train.search_trials(frame, fold_frame, "logistic", ["a", "b"], "y_win", grid).collect()}
    assert len(seen) == 2  # one per fold
    alone = [train.search_trials(frame, fold_frame, "logistic", ["a", "b"], "y_win", [params]).first().mean_logloss for params in grid]
    assert [trials[i] for i in range(3)] == pytest.approx(alone, rel=1e-9)


def _small(spark):
    rows = [(r, h, 3, 2015 + r % 5, float((r * 7 + h * 3) % 11), None if r % 6 == 0 else float(h * r % 5), int(h == r % 3 + 1)) for r in range(60) for h in (1, 2, 3)]
    return spark.createDataFrame(rows, "race_id long, horse_no int, field_size int, year int, a double, b double, y_win int")


def test_converged_fits_serve_larger_limits(spark, monkeypatch):
    """A limit of rounds that was not reached changes nothing, so it costs no fit; one that was reached does."""
    frame = _small(spark).persist()
    fold_frame = folds.year_folds(folds.years_of(frame, "year"), 2020, least=3)
    fits, fit = [], train.fit_binary
    monkeypatch.setattr(train, "fit_binary", lambda *a, **k: fits.append(a[4]) or fit(*a, **k))
    grid = [{"penalty": 1e-3, "rounds": n} for n in (100, 1, 50, 50)]
    trials = {r.trial: r for r in train.search_trials(frame, fold_frame, "logistic", ["a", "b"], "y_win", grid, y_win="y_win").collect()}
    assert sorted(f["rounds"] for f in fits) == [1, 1, 50, 50]  # of eight
    assert trials[0].mean_logloss == trials[2].mean_logloss == trials[3].mean_logloss != trials[1].mean_logloss
    alone = [train.search_trials(frame, fold_frame, "logistic", ["a", "b"], "y_win", [params]).first() for params in grid]
    assert [trials[i].mean_logloss for i in range(4)] == pytest.approx([r.mean_logloss for r in alone], rel=1e-9)
    boosted = [{"rounds": 2, "depth": 2}, {"rounds": 4, "depth": 2}]
    got = {r.trial: r for r in train.search_trials(frame, fold_frame, "gbt", ["a", "b"], "y_win", boosted).collect()}
    assert got[0].folds == got[1].folds == 2 and got[1].median_round >= got[0].median_round >= 1


def test_trials_measure_races_in_one_aggregate(spark):
    """Pseudo-R² of a trial: races with one winner and a known score of it; no join of races back to their rows."""
    rows = [(0, 1, 10, 0, 3, 0.2), (0, 1, 10, 1, 3, 0.5), (0, 1, 10, 0, 3, None), (0, 1, 11, 1, 2, 0.9), (0, 1, 11, 1, 2, 0.1)]
    rows += [(0, 1, 12, 1, 2, None), (0, 1, 12, 0, 2, 0.3), (0, 1, 13, 1, 1, 0.7), (0, 1, None, 1, 2, 0.6), (0, 1, None, 0, 2, 1.0)]
    schema = "trial int, fold_id int, race_id long, y_win int, field_size int, q double"
    table = train.trial_table(spark.createDataFrame(rows, schema).withColumn("best_round", F.lit(None).cast("int")), "y_win", "q", y_win="y_win")
    odds = lambda p: min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))
    model = -math.log(odds(0.5) / (odds(0.5) + odds(0.2))) - math.log(odds(0.6) / (odds(0.6) + odds(1.0)))
    assert table.first().r2_median == pytest.approx(1 - model / (math.log(3) + math.log(2)), rel=1e-9)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of losses and pseudo-R² per fold


def test_folds_are_fitted_together(spark, monkeypatch):
    import threading

    frame = _small(spark).persist()
    gate = threading.Barrier(2, timeout=60)  # passes only if two are under way
    assert train.together(frame, lambda k: (gate.wait(), k * k)[1], [1, 2]) == [1, 4]
    monkeypatch.setattr(train, "TOGETHER_ROWS", 100)  # too many rows: one after the other
    names = train.together(frame, lambda k: threading.current_thread().name, [1, 2, 3])
    assert set(names) == {threading.current_thread().name}
