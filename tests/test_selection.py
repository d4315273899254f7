"""Order statistics by refined histograms against sorted values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalframe.operators import profile, selection


@pytest.mark.parametrize("bins", [2048, 4])
def test_ranks_of_any_distribution(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    rng = np.random.default_rng(3)
    n = 700
    data = {"flags": rng.integers(0, 2, n).astype(float), "ids": np.arange(n) + 2.0**40, "signed": rng.normal(size=n), "powers": 2.0 ** rng.integers(-1000, 1000, n),
            "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 1e-300), "edges": rng.choice([-np.inf, np.inf, 0.0, -0.0, 1.5], n), "one": np.full(n, -3.0)}
    rows = list(zip(*(map(float, v) for v in data.values())))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    want = [0, 1, n // 4, n // 2, n - 1]
    found = selection.order_statistics(df, {c: F.col(c) for c in data}, {c: want for c in data})
    for c, v in data.items():
        assert [found.values[c, k] for k in want] == (np.sort(v)[want] + 0.0).tolist(), c
    if bins == 2048:
        assert found.distinct["flags"] == 2 and found.distinct["one"] == 1 and found.distinct["edges"] == 4


def test_quantiles_leave_out_missing_values(spark):
    rows = [(None, 1.0), (float("nan"), 2.0), (3.0, 4.0), (5.0, 8.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got, _ = selection.quantiles(df, {c: F.col(c) for c in "ab"}, {"a": 2, "b": 4}, [0.25, 0.5])
    assert got == {"a": [3.5, 4.0], "b": [1.75, 3.0]}
    empty, found = selection.quantiles(df.limit(0), {"a": F.col("a")}, {"a": 0}, [0.5])
    assert empty == {"a": [None]} and not found.values


def test_statistics_of_odd_columns(spark):
    rows = [(i, float(i % 3) if i % 4 else None, None, float("nan")) for i in range(2**53, 2**53 + 40)]
    df = spark.createDataFrame(rows, "big long, few double, none int, nan double").repartition(3)
    got = {r["column"]: r for r in profile.column_statistics(df).collect()}
    assert got["big"].unique_count == 40 and (got["big"].min_whole, got["big"].max_whole) == (2**53, 2**53 + 39)
    assert got["few"].unique_count == 3 and got["few"].missing_count == 10 and got["few"].missing_percent == 25.0
    assert got["none"]["count"] == got["nan"]["count"] == 0 and got["nan"].unique_count == 0 and got["none"].p50 is None
    some = {r["column"]: r.unique_count for r in profile.column_statistics(df, distinct=[]).collect()}
    assert some["few"] == 3 and some["big"] is None
    assert profile.column_statistics(df.limit(0)).where("count > 0").isEmpty()
