"""Registered queries use all the data and the learners' own settings."""

import datetime
from types import SimpleNamespace

from turfspark.catalog import history, training


def test_feature_table_runs_to_the_last_race(spark, monkeypatch):
    days = [(datetime.date(1995, 1, 1),), (datetime.date(1998, 5, 5),), (datetime.date(2001, 8, 2),)]
    seen = []
    monkeypatch.setattr(history, "core_tables", lambda t: {})
    monkeypatch.setattr(history.features, "base_features", lambda tables, first, last, with_te: seen.append((first, last)))
    history.feature_table(SimpleNamespace(race=spark.createDataFrame(days, "race_date date")))
    history.feature_table(SimpleNamespace(race=spark.createDataFrame([], "race_date date")))
    assert seen == [("1996-12-31", "2001-08-02"), ("1970-01-01", "1970-01-01")]


def test_training_uses_the_learners_settings(monkeypatch):
    seen = []
    monkeypatch.setattr(training, "_folds", lambda rows: None)
    monkeypatch.setattr(training.train, "cross_validate", lambda *a, **k: seen.append((a[2], k.get("params"))))
    for name in ("gbt", "forest", "logistic"):
        training._oof(None, name)
    assert seen == [("gbt", None), ("forest", None), ("logistic", None)]
