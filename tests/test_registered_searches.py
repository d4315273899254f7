"""The registered searches run whole; a search resumes from its ledger; late trials are recorded."""

import json

import numpy as np
import pytest

from vitalframe.operators import models as mo
from vitalframe.operators import search
from vitalframe.plans import batch
from vitalframe.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_cross_validation_of_all_models(spark):
    rows = QUERIES["M8_M9_cross_validation"](spark, SF).collect()
    assert {(r.model, r.metric) for r in rows} == {(m, k) for m in mo.MODEL_CONFIG for k in ("accuracy", "f1_score", "roc_auc")}
    for r in rows:
        assert len(r.scores) == 5 and r["mean"] == pytest.approx(sum(r.scores) / 5, abs=1e-5)
    assert all(r["mean"] > 0.85 for r in rows if r.metric == "roc_auc")
    assert sum(r.is_best for r in rows) == 3


def test_grid_search_over_all_points(spark):
    rows = QUERIES["M12_grid_search"](spark, SF).collect()
    assert {r.params for r in rows} == {json.dumps(p, sort_keys=True) for p in mo.grid_points(mo.RETRAIN_GRID)} and len(rows) == 162
    assert all(r.error is None and 0.8 < r.cv_auc <= 1 and r.fit_rows == search.FIT_ROWS for r in rows)


def test_random_search_of_all_models(spark):
    rows = QUERIES["M13_M14_random_search"](spark, SF).collect()
    for m in mo.MODEL_CONFIG:
        got = {json.dumps(p, sort_keys=True) for p in mo.sample_params(m, 50)}
        assert {r.params for r in rows if r.model == m} == got
    assert len(rows) == 200 and not any(r.error for r in rows)
    assert [r.is_best for r in rows] == [True] + [False] * 199 and rows[0].score == max(r.score for r in rows)


GRID = {"n_estimators": [4, 8], "max_depth": [2, 3], "learning_rate": [0.3]}


def test_resumes_from_the_ledger(spark, monkeypatch, tmp_path):
    df = batch.featured(spark, SF)
    want = {r.params: r.cv_auc for r in search.grid_search(df, GRID)[2].collect()}
    ledger, enter, entered = str(tmp_path / "ledger"), search._enter, []

    def some(rows, path):
        if len(entered) == 2:
            raise RuntimeError("stopped midway")
        entered.append(path)
        enter(rows, path)

    monkeypatch.setattr(search, "_enter", some)
    monkeypatch.setattr(search, "SEQUENCES", 1)
    with pytest.raises(RuntimeError):
        search.grid_search(df, GRID, ledger=ledger, parallelism=1)
    held = search.ledger_pairs(spark, ledger)
    assert len(held) == 4  # two jobs of two points each
    again = []
    monkeypatch.setattr(search, "_enter", lambda rows, path: (again.append(path), enter(rows, path)))
    best, score, table = search.grid_search(df, GRID, ledger=ledger)
    assert len(again) == 4  # two sequences in three folds, less two
    got = {r.params: r.cv_auc for r in table.collect()}
    assert got == pytest.approx(want) and score == max(want.values()) and json.dumps(best, sort_keys=True) in want
    again.clear()
    search.grid_search(df, GRID, ledger=ledger)
    assert not again


def test_late_and_failing_trials(spark):
    df = batch.featured(spark, SF)
    with pytest.raises(ValueError, match="over 0.01 s"):
        search.grid_search(df, {"n_estimators": [3000], "max_depth": [9]}, time_limit=0.01)
    with pytest.raises(Exception, match="learning_rate|KeyError|float"):
        search.grid_search(df, {"learning_rate": ["fast"]})
    table = search.grid_search(df, {"learning_rate": ["fast", 0.3], "n_estimators": [3]})[2]
    errors = {r.params: (r.cv_auc, r.error) for r in table.collect()}
    assert len(errors) == 2 and sorted(e is None for _, e in errors.values()) == [False, True]


def test_one_sequence_serves_all_its_lengths(spark):
    df = batch.featured(spark, SF)
    sample = search.draw(df, ["ap_hi", "age_years", "bmi"], 3, 500)
    trial = lambda n: (str(n), {**mo.MODEL_CONFIG["XGBoost"], "n_estimators": n})
    both = search.fit_job("XGBoost", 1, [trial(3), trial(9)], sample, 42)
    alone = search.fit_job("XGBoost", 1, [trial(3)], sample, 42)
    assert both[both.trial == "3"].probability.to_numpy() == pytest.approx(alone.probability.to_numpy(), abs=1e-12)
    assert set(both.id) == set(sample.key[sample.fold == 1].tolist())


def test_logistic_scores_are_the_optimum(spark):
    df = batch.featured(spark, SF)
    sample = search.draw(df, ["ap_hi", "age_years", "bmi"], 3, 500)
    x = (sample.x - sample.x.mean(0)) / sample.x.std(0)
    w = search.newton(x, sample.y, 0.7)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert abs(w[:-1] + 0.7 * x.T @ (p - sample.y)).max() < 1e-5 and abs((p - sample.y).sum()) < 1e-5
