"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from tools import check

FOLDER = "/root/testdata/sf0.001"
# model fits and sampled estimates are covered by tests of their own
SLOW = {"gbt_oof", "stacker_oof", "parameter_search", "oof_fold_metrics", "pl_fit_score", "win_scores_at_best_beta"}
# fits whose operators tests/test_layers.py covers; minutes together
SLOW |= {
    "early_stopping_folds", "early_stopping_report", "final_fit_rounds", "final_model_holdout", "boosted_win_evaluation",
    "learner_predictions", "stacker_win_oof", "stacker_place_oof", "stacker_reports", "search_best",
    "ranking_cv_horses", "ranking_cv_pairs", "ranking_cv_metrics", "ranking_cv_segments", "ranking_cv_models",
    "ranking_holdout_pairs", "ranking_holdout_metrics",
}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW or os.environ.get("ALL_QUERIES")])
def test_query(spark, name):
    verdict, _ = check.compare(spark, check.connect(FOLDER), name, FOLDER, entry.queries(), entry.oracle_sql())
    assert verdict.startswith(("ok", "rows-only")), verdict
