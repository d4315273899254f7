"""Bands from a caller's table, and previous runs as of a time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitalframe.operators import models as mo
from vitalframe.operators import outliers as ol
from vitalframe.operators import trees as tr
from vitalframe.operators.tree_score import BoostedBundle


def plain_band(x, bands):
    if x is None or x != x:
        return None
    return next((n for n, lo, hi in bands if (lo is None or x >= lo) and (hi is None or x < hi)), None)


@pytest.mark.parametrize("seed", range(4))
def test_bands_with_gaps_overlaps_and_open_ends(spark, seed):
    rng = random.Random(seed)
    bands = []
    for i in range(rng.randint(0, 12)):
        lo, hi = sorted((rng.randint(-5, 20), rng.randint(-5, 20)))
        bands.append((f"b{i}", None if rng.random() < 0.15 else float(lo), None if rng.random() < 0.15 else float(hi)))
    bounds, stretches = ol.elementary_bands(bands)
    values = [None, float("nan"), float("inf"), -1e300] + [k / 2 for k in range(-14, 44)]
    table = spark.createDataFrame([(i, *b) for i, b in enumerate(bands)], "rank int, name string, low double, high double")
    df = spark.createDataFrame([(i, v, "kept") for i, v in enumerate(values)], "id int, x double, name string")
    got = {r.id: r for r in ol.with_band(df, "x", table).collect()}
    assert [got[i].band for i in range(len(values))] == [plain_band(v, bands) for v in values]
    assert all(r.name == "kept" for r in got.values()) and len(bounds) <= 2 * len(bands)
    plan = ol.with_band(df, "x", table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bands_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ol, "MAX_BANDS", 2)
    table = spark.createDataFrame([("a", 0.0, 1.0)] * 3, "name string, low double, high double")
    with pytest.raises(ValueError):
        ol.with_band(spark.range(1).withColumn("x", F.lit(0.5)), "x", table)


def test_previous_run_as_of_each_time(spark):
    day = dt.datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), day + dt.timedelta(hours=rng.randint(0, 90)), rng.random()) for i in range(120)]
    rows += [(200, "a", None, 0.5), (201, "a", day + dt.timedelta(hours=200), None), (202, "a", day + dt.timedelta(hours=300), 0.7), (203, None, day, 0.1), (204, None, day + dt.timedelta(hours=1), 0.2), (205, "c", day, 0.0), (206, "c", day + dt.timedelta(days=9), 0.3)]
    rng.shuffle(rows)  # late rows come in any order
    got = {r.run_id: r for r in mo.previous_runs_as_of(spark.createDataFrame(rows, "run_id int, model string, logged_at timestamp, value double").repartition(4)).collect()}
    assert len(got) == len(rows)
    for i, m, at, v in rows:
        before = [(t, j, w) for j, n, t, w in rows if n == m and at and t and t < at and w is not None]
        want = max(before, default=(None, None, None))
        assert (got[i].previous_run, got[i].previous_value) == want[1:]
        if want[2] and v is not None:
            assert got[i].improvement_pct == pytest.approx((v - want[2]) / want[2] * 100)
        else:
            assert got[i].improvement_pct is None


def test_boosted_bundle_is_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), int(i % 7 > 3)) for i in range(60)], "id int, a double, cardio int")
    b = BoostedBundle("XGBoost", tr.fit_boosted(df, ["a"], tr.TreeParams(rounds=3)), {"depth": 5})
    b.save(str(tmp_path / "m"))
    again = mo.ModelBundle.load(str(tmp_path / "m"))
    assert again == b and again.score(df).collect() == b.score(df).collect()
    with pytest.raises(ValueError):
        b.score(df.drop("a"))
