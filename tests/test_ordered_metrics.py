"""Distributed ordered statistics and evaluation metrics against brute force."""

import numpy as np
import pandas as pd
import pytest

from vitalframe.operators import metrics as ev
from vitalframe.operators.ordered import exact_quantiles, exclusive_prefix_sums


def _brute_auc(y, p):
    pos = [pi for yi, pi in zip(y, p) if yi == 1]
    neg = [pi for yi, pi in zip(y, p) if yi == 0]
    s = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_prefix_sums_match_cumsum(spark, seed):
    rng = np.random.default_rng(seed)
    n = 500
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "k": rng.integers(0, 60, n).astype(float),
                        "t": np.arange(n), "v": rng.integers(0, 10, n)})
    df = spark.createDataFrame(pdf)
    got = exclusive_prefix_sums(df, ["g"], ["k", "t"], ["v"], num_buckets=7).toPandas()
    want = pdf.sort_values(["g", "k", "t"]).copy()
    want["before_v"] = want.groupby("g")["v"].cumsum() - want["v"]
    m = got.merge(want, on=["g", "k", "t", "v"], suffixes=("", "_w"))
    assert len(m) == n
    assert (m["before_v"] == m["before_v_w"]).all()


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = {"a": rng.integers(0, 20, 301).astype(float), "b": rng.normal(size=64)}
    rows = [(k, float(x)) for k, arr in vals.items() for x in arr] + [("a", None)]
    df = spark.createDataFrame(rows, "column string, value double")
    got = {r["column"]: r for r in exact_quantiles(df, "column", "value", [0.25, 0.5, 0.75],
                                                   num_buckets=5).collect()}
    for k, arr in vals.items():
        for q, name in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]:
            assert got[k][name] == pytest.approx(np.quantile(arr, q), rel=1e-12, abs=1e-12)


def _scored(spark, y, p):
    pred = [int(x > 0.5) for x in p]
    return spark.createDataFrame(list(zip(range(len(y)), y, p, pred)),
                                 "id long, label int, probability double, prediction int")


def test_auc_with_ties_matches_pairwise(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400).tolist()
    p = (np.round(rng.random(400) * 20) / 20).tolist()  # many ties
    got = ev.roc_auc(_scored(spark, y, p), num_buckets=6, constant_score_auc=None).first()[0]
    assert got == pytest.approx(round(_brute_auc(y, p), 6), abs=1e-6)


def test_auc_edge_cases(spark):
    assert ev.roc_auc(_scored(spark, [0, 1, 0, 1], [0.3] * 4)).first()[0] == 0.0
    assert ev.roc_auc(_scored(spark, [0, 1, 0, 1], [0.3] * 4), constant_score_auc=None).first()[0] == 0.5
    assert ev.roc_auc(_scored(spark, [1, 1], [0.2, 0.4])).first()[0] is None


def test_calibration_matches_binning_rule(spark):
    rng = np.random.default_rng(11)
    p = np.concatenate([rng.random(300), [0.1, 0.30000000000000004, 0.7000000000000001, 0.0, 1.0]])
    y = rng.integers(0, 2, len(p))
    edges = np.linspace(0.0, 1.0, 11)
    ids = np.searchsorted(edges[1:-1], p)
    tot = np.bincount(ids, minlength=10)
    nz = tot != 0
    pt = np.bincount(ids, weights=y, minlength=10)[nz] / tot[nz]
    pp = np.bincount(ids, weights=p, minlength=10)[nz] / tot[nz]
    want = float(np.mean(np.abs(pt - pp)))
    got = ev.calibration_error(_scored(spark, y.tolist(), p.tolist())).first()[0]
    assert got == pytest.approx(want, abs=1e-6)


def test_threshold_sweep_and_report(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 200)
    p = rng.random(200)
    sw = {r.threshold: r for r in ev.threshold_sweep(_scored(spark, y.tolist(), p.tolist())).collect()}
    for t in ev.THRESHOLDS:
        pr = (p >= t).astype(int)
        tp, fp = int(((pr == 1) & (y == 1)).sum()), int(((pr == 1) & (y == 0)).sum())
        fn = int(((pr == 0) & (y == 1)).sum())
        assert sw[t].precision == pytest.approx(tp / (tp + fp) if tp + fp else 0.0, abs=1e-6)
        assert sw[t].recall == pytest.approx(tp / (tp + fn) if tp + fn else 0.0, abs=1e-6)
    rep = {r["class"]: r for r in ev.classification_report(_scored(spark, y.tolist(), p.tolist())).collect()}
    assert rep["0"].support + rep["1"].support == 200
    assert rep["macro avg"].f1_score == pytest.approx((rep["0"].f1_score + rep["1"].f1_score) / 2, abs=2e-6)


def test_zero_division_gives_zero(spark):
    m = ev.basic_metrics(_scored(spark, [0, 0, 1], [0.1, 0.2, 0.3])).first()
    assert m.precision == 0.0 and m.recall == 0.0 and m.f1_score == 0.0


# ------------------------------------------------------------ hot keys (a third of all rows)

def test_auc_with_hot_score_matches_pairwise(spark):
    rng = np.random.default_rng(11)
    n = 600
    y = rng.integers(0, 2, n).tolist()
    p = rng.random(n)
    p[: n // 3] = 0.5  # one score shared by a third of the rows
    p = p.tolist()
    got = ev.roc_auc(_scored(spark, y, p), num_buckets=6, constant_score_auc=None).first()[0]
    assert got == pytest.approx(round(_brute_auc(y, p), 6), abs=1e-6)


def test_exact_quantiles_with_hot_value(spark):
    rng = np.random.default_rng(12)
    arr = rng.normal(size=900)
    arr[::3] = 1.25  # a third of the values are one value
    df = spark.createDataFrame([("x", float(v)) for v in arr], "column string, value double")
    got = exact_quantiles(df, "column", "value", [0.1, 0.5, 0.9], num_buckets=6).first()
    for q, name in [(0.1, "q10"), (0.5, "q50"), (0.9, "q90")]:
        assert got[name] == pytest.approx(np.quantile(arr, q), rel=1e-12, abs=1e-12)


def test_prefix_sums_hot_group_spans_buckets(spark):
    rng = np.random.default_rng(13)
    n = 900
    g = np.where(np.arange(n) < 2 * n // 3, 0, rng.integers(1, 4, n))  # group 0 holds 2/3
    pdf = pd.DataFrame({"g": g, "k": rng.random(n), "v": rng.integers(0, 10, n)})
    df = spark.createDataFrame(pdf)
    got = exclusive_prefix_sums(df, ["g"], ["k"], ["v"], num_buckets=8).toPandas()
    want = pdf.sort_values(["g", "k"]).copy()
    want["before_v"] = want.groupby("g")["v"].cumsum() - want["v"]
    m = got.merge(want, on=["g", "k", "v"], suffixes=("", "_w"))
    assert len(m) == n and (m["before_v"] == m["before_v_w"]).all()
    # The hot group's window work is cut into several range buckets.
    from vitalframe.operators.ordered import range_bounds, with_bucket
    b = with_bucket(df, "k", range_bounds(df, "k", 8))
    assert b.where("g = 0").select("_bucket").distinct().count() > 1


def test_exact_rank_and_folds_with_hot_id(spark):
    from vitalframe.operators.split import _rank_in_label, kfold
    rng = np.random.default_rng(14)
    n = 600
    ids = np.where(np.arange(n) < n // 3, 7, np.arange(n))  # one id on a third of the rows
    pdf = pd.DataFrame({"id": ids, "cardio": rng.integers(0, 2, n), "v": np.arange(n)})
    df = spark.createDataFrame(pdf)
    ranked = _rank_in_label(df, "id", 42, "cardio").toPandas()
    for lab, grp in ranked.groupby("cardio"):
        assert sorted(grp["_rank"]) == list(range(len(grp)))  # a permutation: no rank ties
    per = kfold(df, k=5, exact=True).groupBy("cardio", "fold").count().collect()
    for lab in (0, 1):
        sizes = [r["count"] for r in per if r.cardio == lab]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
