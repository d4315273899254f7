"""Every registered query with an oracle matches DuckDB at sf0.001 (fast subset of the gate)."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SLOW = {"M", "E12", "K1_fitted", "S7", "S8"}


def _norm(v):
    if hasattr(v, "asDict"):
        return {k: _norm(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((repr([_norm(r[i]) for i in order]) for r in recs))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in sorted(glob.glob(f"{SF}/*.parquet")):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


NAMES = sorted(set(E.queries()) & set(E.oracle_sql()))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srecs = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srecs) == _rows(dcols, cur.fetchall())


def test_entry_runs(spark):
    out = E.entry(spark)
    assert out.columns == ["bp_category", "patients", "cardio_rate", "mean_age"]
    assert out.count() > 0
