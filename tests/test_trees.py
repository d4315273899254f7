"""Histogram trees: against a plain recursive booster, over blocks, with limits, and as columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalframe.operators import models as mo
from vitalframe.operators import trees as tr
from vitalframe.operators.tree_score import TreeRiskModel

NAMES = ["a", "b", "c"]


def data(n=240, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0.1)).astype(float)
    flip = rng.random(n) < 0.1
    return x, np.where(flip, 1 - y, y)


def table(spark, x, y, parts=4):
    rows = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, cardio int").repartition(parts, "id")


def plain_tree(bins, g, h, rows, depth, p):
    """Value of every row in ``rows`` by plain recursion."""
    out = {}
    sum_g, sum_h, n = g[rows].sum(), h[rows].sum(), len(rows)
    weight = (lambda r: h[r].sum() + p.l2) if p.kind == "xgb" else (lambda r: len(r) + p.l2)
    best = (1e-10 + p.gain, None)
    if depth < p.depth and n >= p.split_rows:
        for f in range(bins.shape[1]):
            for cut in range(tr.BINS):
                low, high = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                if min(len(low), len(high)) < max(p.leaf_rows, 1):
                    continue
                if p.kind == "xgb" and min(h[low].sum(), h[high].sum()) < p.child_weight:
                    continue
                gain = (g[low].sum() ** 2 / weight(low) + g[high].sum() ** 2 / weight(high) - sum_g**2 / weight(rows)) / 2
                if gain > best[0] + 1e-12:
                    best = (gain, (low, high))
    if best[1] is None:
        return {int(r): -sum_g / (sum_h + p.l2) for r in rows}
    for part in best[1]:
        out |= plain_tree(bins, g, h, part, depth + 1, p)
    return out


def plain_boosting(bins, y, p):
    margin = np.full(len(y), tr.start_margin(p, y.mean()))
    for _ in range(p.rounds):
        prob = 1 / (1 + np.exp(-margin))
        value = plain_tree(bins, prob - y, prob * (1 - prob), np.arange(len(y)), 0, p)
        margin = margin + p.rate * np.array([value[i] for i in range(len(y))])
    return margin


XGB = tr.TreeParams("xgb", 6, 3, 0.3, child_weight=2.0, l2=1.5, gain=0.05)
GB = tr.TreeParams("gb", 5, 3, 0.2, l2=0.0, split_rows=12, leaf_rows=5)


@pytest.mark.parametrize("p", [XGB, GB])
def test_against_plain_boosting(p):
    x, y = data()
    bins = tr.to_bins(x, [np.unique(np.quantile(c, np.arange(1, 16) / 16)).tolist() for c in x.T])
    got = tr.margins(bins, y, np.arange(len(y)), [p], np.ones((1, len(y)), bool), [[p.rounds]])[0][p.rounds]
    assert got == pytest.approx(plain_boosting(bins, y, p), abs=1e-9)


def test_models_grown_together_are_those_grown_alone():
    x, y = data()
    key = np.arange(len(y)) * 7919
    bins = tr.to_bins(x, [np.unique(np.quantile(c, np.arange(1, 16) / 16)).tolist() for c in x.T])
    params = [XGB, GB, tr.TreeParams("xgb", 4, 5, 0.1, rows=0.7, columns=0.67), tr.TreeParams("forest", 30, 6, 1.0, l2=0.0, leaf_rows=2)]
    taking = np.stack([key % 3 != k % 3 for k in range(4)])
    report = [[2, 6], [5], [4], [10, 30]]
    together = tr.margins(bins, y, key, params, taking, report)
    for m, p in enumerate(params):
        alone = tr.margins(bins, y, key, [p], taking[m : m + 1], [report[m]])[0]
        for k in report[m]:
            assert together[m][k] == pytest.approx(alone[k], abs=1e-12)
    assert ((together[3][30] >= 0) & (together[3][30] <= 1)).all()


@pytest.mark.parametrize("p", [XGB, GB, tr.TreeParams("xgb", 4, 3, 0.3, rows=0.8, columns=0.67)])
def test_blocks_give_the_same_trees(spark, monkeypatch, p):
    x, y = data()
    df = table(spark, x, y)
    whole = tr.fit_boosted(df, NAMES, p)
    monkeypatch.setattr(tr, "BLOCK_ROWS", 37)  # the tasks' own blocks stay as their workers have it; more than one task holds rows
    monkeypatch.setattr(tr, "WRITE_EVERY", 3)
    spread = tr.fit_boosted(df, NAMES, p)
    assert len(whole.trees) == len(spread.trees) == p.rounds
    for a, b in zip(whole.trees, spread.trees):
        assert (a["feature"], a["bound"], a["low"], a["high"]) == (b["feature"], b["bound"], b["low"], b["high"])
        assert a["value"] == pytest.approx(b["value"], abs=1e-9)
    assert tr.BoostedModel.from_json(whole.to_json()) == whole


def test_a_round_takes_one_job_a_level(spark, monkeypatch):
    x, y = data()
    df = table(spark, x, y).cache()
    monkeypatch.setattr(tr, "BLOCK_ROWS", 37)

    def jobs(rounds):
        group = f"fit-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        tr.fit_boosted(df, NAMES, tr.TreeParams("xgb", rounds, 3, 0.1, l2=0.5))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    jobs(1)
    assert jobs(7) - jobs(3) <= 4 * 3
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_shared_codes_give_the_sums_of_a_level():
    rng = np.random.default_rng(3)
    sizes = [32, 3, 2, 7, 4, 30]
    bins = np.stack([rng.integers(0, n, 500) for n in sizes], 1).astype(np.uint8)
    y, key, margin = rng.integers(0, 2, 500).astype(float), np.arange(500), rng.normal(size=500)
    p = tr.TreeParams("xgb", 2, 4, 0.3, rows=0.8, columns=0.67)
    groups = tr.packs(sizes, 64)
    assert sorted(f for g in groups for f in g) == list(range(6)) and len(groups) < 6
    row = {"n": 500, "bins": bins.tobytes(), "y": y.tobytes(), "key": key.tobytes(), "margin": margin.tobytes()}
    growth = tr.Growth([p], np.array([0]), 0, 6)
    more = True
    while more:
        shared = type("Shared", (), {"value": (growth, groups, sizes, tr.BINS)})
        got = next(tr._level(tr._held([row], p, groups, sizes), shared))
        w = tr._weights(p, key, 0, np.ones(500, bool))
        g, h = tr._gradients(p, margin, y, w)
        slot = np.full(len(growth.trees.feature), -1)
        slot[growth.open] = np.arange(len(growth.open))
        at = slot[tr.descend(growth.trees.arrays(), bins, np.full((1, 500), growth.roots[0]))[0]]
        take = np.flatnonzero((at >= 0) & (w > 0))
        want = tr.level_sums(bins, take, at[take], growth.chosen, g[take], h[take], w[take])
        assert got == pytest.approx(want, abs=1e-12)
        more = growth.split(got)


def test_columns_make_a_rows_inputs_once(spark):
    tree = {"feature": [0, 0, 0], "cut": [1.0, 0.0, 0.0], "low": [1, -1, -1], "high": [2, -1, -1], "value": [0.0, -1.0, 1.0]}
    m = TreeRiskModel.from_trees(["a"], [tree, tree])
    plan = spark.range(3).select(F.col("id").cast("double").alias("a")).select(m.probability().alias("p"))._jdf.queryExecution().analyzed().toString()
    # the inputs are the argument of the outer function, outside every tree's walk
    assert "transform(array(array(" in plan


def test_limits_and_odd_tables(spark):
    x, y = data()
    flat = tr.fit_boosted(table(spark, x, y), NAMES, tr.TreeParams("xgb", 2, 4, gain=1e6))
    assert all(t["low"] == [-1] for t in flat.trees)
    holes = table(spark, x, y).withColumn("a", F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("a")))
    model = tr.fit_boosted(holes, NAMES, XGB)
    columns = holes.select("id", TreeRiskModel.from_boosted(model).probability().alias("p"))
    assert tr.score_boosted(holes, model).join(columns, "id").where("abs(p - probability) > 1e-12").isEmpty()
    one_class = tr.fit_boosted(table(spark, x, np.ones(len(y))), NAMES, GB)
    assert all(t["low"] == [-1] for t in one_class.trees)
    assert tr.fit_boosted(table(spark, x, y).limit(0), NAMES, XGB).trees == []
    with pytest.raises(ValueError):
        tr.fit_boosted(table(spark, x, y), NAMES, tr.TreeParams("forest"))


@pytest.mark.parametrize("name", ["Random_Forest", "Gradient_Boosting", "XGBoost"])
def test_columns_score_as_the_fitted_model(spark, name):
    x, y = data()
    df = table(spark, x, y)
    bundle = mo.fit_bundle(name, df, NAMES, {"n_estimators": 12, "max_depth": 4})
    model = TreeRiskModel.from_spark(bundle)
    both = bundle.score(df).join(df.select("id", model.probability().alias("p"), model.prediction().alias("c")), "id")
    assert both.where("abs(p - probability) > 1e-12 or c != prediction").isEmpty() and both.count() == len(y)
    assert TreeRiskModel.from_json(model.to_json()) == model


def test_missing_values_and_single_leaves(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5), (3, 2.0), (4, float("nan"))], "id int, a double")
    tree = {"feature": [0, 0, 0], "cut": [1.0, 0.0, 0.0], "low": [1, -1, -1], "high": [2, -1, -1], "value": [0.0, -1.0, 1.0]}
    for missing_low, want in ((True, [-1, -1, 1, -1]), (False, [1, -1, 1, 1])):
        m = TreeRiskModel.from_trees(["a"], [tree], missing_low=missing_low, link="share")
        assert [r[0] for r in df.orderBy("id").select(m.probability()).collect()] == want
    leaf = TreeRiskModel.from_trees(["a"], [{"feature": [0], "cut": [0.0], "low": [-1], "high": [-1], "value": [0.25]}], link="share")
    assert [r[0] for r in df.select(leaf.probability()).collect()] == [0.25] * 4
    assert [r[0] for r in df.select(TreeRiskModel.from_trees(["a"], []).probability()).collect()] == [0.5] * 4
