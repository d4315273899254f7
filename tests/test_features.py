"""Feature derivation (mirrors the reference's feature tests, plus exact rounding)."""

import math

import numpy as np
import pytest

from tests.conftest import raw_frame
from vitalframe.functions import clinical as fx
from vitalframe.operators.features import add_features, feature_catalog, serving_features
from vitalframe.schema import ENGINEERED_FEATURES, MODEL_FEATURES


def _clean_rows(spark, heights, weights, his=None, los=None):
    n = len(heights)
    his = his or [120] * n
    los = los or [80] * n
    rows = [(i, 20000, 1, h, float(w), s, d, 1, 1, 0, 0, 1, 0)
            for i, (h, w, s, d) in enumerate(zip(heights, weights, his, los))]
    return raw_frame(spark, rows).withColumn("age_years", fx.age_years())


def test_bmi_exact(spark):
    df = _clean_rows(spark, [170], [70])
    got = add_features(df).first().bmi
    assert abs(got - 70 / 1.7 ** 2) < 0.1
    assert got == 24.22


def test_bmi_matches_numpy_rounding(spark):
    h = [170, 165, 180, 175, 160]
    w = [70, 80, 75, 100, 45]
    got = [r.bmi for r in add_features(_clean_rows(spark, h, w)).orderBy("id").collect()]
    want = np.round(np.array(w) / (np.array(h) / 100) ** 2, 2).tolist()
    assert got == want


def test_bp_features_and_categories(spark):
    his, los = [120, 140, 160, 180, 110], [80, 90, 100, 110, 70]
    df = add_features(_clean_rows(spark, [170] * 5, [70] * 5, his, los)).orderBy("id").collect()
    assert [r.pulse_pressure for r in df] == [h - lo for h, lo in zip(his, los)]
    # Training profile: 120/80 is class 2 (neither < 120 nor < 80 for the first rules).
    assert [r.bp_category for r in df] == [2, 3, 3, 3, 0]
    got_serve = [r.b for r in _clean_rows(spark, [170] * 5, [70] * 5, his, los)
                 .select("id", fx.bp_category_serve().alias("b")).orderBy("id").collect()]
    assert got_serve == [0, 2, 3, 4, 0]


def test_crisis_needs_both_high(spark):
    df = _clean_rows(spark, [170, 170], [70, 70], [185, 185], [100, 125])
    assert [r.bp_category for r in add_features(df).orderBy("id").collect()] == [3, 4]


def test_risk_scores_ranges(spark):
    rows = [(i, 20000 + 500 * i, 1 + i % 2, 170, 70.0 + i, 120 + i, 80, 1 + i % 3, 1 + i % 3, i % 2,
             (i + 1) % 2, i % 2, 0) for i in range(3)]
    df = add_features(raw_frame(spark, rows).withColumn("age_years", fx.age_years())).collect()
    for r in df:
        assert 0 <= r.lifestyle_risk_score <= 3
        assert 2 <= r.metabolic_risk_score <= 6
        assert 0 <= r.combined_risk_score <= 100
        want = round(r.bp_category / 4 * 30 + r.bmi_category / 3 * 20
                     + r.lifestyle_risk_score / 3 * 25 + r.metabolic_risk_score / 6 * 25, 1)
        assert math.isclose(r.combined_risk_score, want, abs_tol=0.051)


def test_all_engineered_columns_present(spark):
    out = add_features(_clean_rows(spark, [170], [70]))
    assert set(ENGINEERED_FEATURES) <= set(out.columns)
    assert set(MODEL_FEATURES) <= set(out.columns)


def test_flags_check_dependencies(spark):
    with pytest.raises(ValueError):
        add_features(_clean_rows(spark, [170], [70]), create_bmi=False)


def test_serving_row_has_20_columns(spark):
    from vitalframe.schema import REQUEST_SCHEMA
    req = spark.createDataFrame([(1, 55, "Male", 175.0, 82.0, 135, 85, 2, 1, 1, 0, 0)], REQUEST_SCHEMA)
    out = serving_features(req)
    assert out.columns == ["request_id"] + MODEL_FEATURES
    r = out.first()
    assert r.gender == 2 and r.age_years == 55 and r.bp_category == 1


def test_feature_catalog(spark):
    cat = {r.feature: r for r in feature_catalog(spark).collect()}
    assert cat["age_years"].importance_rank == 1
    assert cat["bmi"].engineered and cat["bmi"].description.startswith("Body Mass Index")
    assert len([r for r in cat.values() if r.engineered]) == 18
