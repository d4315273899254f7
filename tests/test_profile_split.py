"""Profiling, splits and scaling."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01, raw_frame
from vitalframe.operators import profile as P
from vitalframe.operators import split as S
from vitalframe.plans import batch


def test_dataset_info_shape(spark):
    df = spark.createDataFrame([(50, 170, 70.0, 0), (55, 165, 80.0, 1), (60, 180, 75.0, 0),
                                (45, 175, 100.0, 1), (50, 170, 70.0, 0)],
                               "age long, height long, weight double, cardio long")
    info = P.dataset_info(df).first()
    assert (info.n_rows, info.n_columns) == (5, 4)
    assert info.columns == ["age", "height", "weight", "cardio"]
    assert info.duplicates == 1


def test_schema_valid_and_errors(spark):
    rows = [(i, 18000 + i, 1, 170, 70.0, 120, 80, 1, 1, 0, 0, 1, 0) for i in range(3)]
    assert P.schema_verdict(raw_frame(spark, rows)).first().is_valid
    bad = raw_frame(spark, rows).drop("gluc").withColumn("gender", F.lit("x"))
    errs = {(r.check, r.column) for r in P.schema_errors(bad).collect()}
    assert ("missing_column", "gluc") in errs and ("non_numeric", "gender") in errs


def test_quality_score_range(spark):
    rows = [(i, 18000, 1 + i % 2, 170, 70.0, 120, 80, 1 + i % 3, 1, 0, 0, 1, i % 2) for i in range(5)]
    rep = {r.check: r for r in P.quality_report(raw_frame(spark, rows)).collect()}
    assert 0 <= rep["quality_score"].value <= 100
    assert rep["quality_score"].value == 100.0


def test_null_counts_as_invalid_categorical(spark):
    rows = [(1, 18000, None, 170, 70.0, 120, 80, 1, 1, 0, 0, 1, 0),
            (2, 18000, 1, 170, 70.0, 120, 80, 1, 1, 0, 0, 1, 0)]
    chk = {r.column: r for r in P.categorical_checks(raw_frame(spark, rows)).collect()}
    assert not chk["gender"].passed
    chk2 = {r.column: r for r in P.categorical_checks(raw_frame(spark, rows), null_is_invalid=False).collect()}
    assert chk2["gender"].passed


def test_split_shares_and_stability(spark):
    f = batch.featured(spark, SF01)
    s = S.train_val_test_split(f)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    n = sum(counts.values())
    assert counts["test"] / n == pytest.approx(0.20, abs=0.02)
    assert counts["validation"] / n == pytest.approx(0.15, abs=0.02)
    again = {r.split: r["count"] for r in S.train_val_test_split(f).groupBy("split").count().collect()}
    assert again == counts


def test_exact_kfold_is_stratified(spark):
    f = batch.featured(spark, SF01)
    k = S.kfold(f, k=5, exact=True)
    per = k.groupBy("cardio", "fold").count().collect()
    for lab in (0, 1):
        sizes = [r["count"] for r in per if r.cardio == lab]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_standard_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    m = S.fit_standard_scaler(df, ["x"])
    assert m.scale["x"] == pytest.approx(1.247219, abs=1e-6)
    out = [r.x for r in m.transform(df, ["x"]).collect()]
    assert sum(out) == pytest.approx(0.0, abs=1e-12)
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert S.fit_standard_scaler(const, ["x"]).scale["x"] == 1.0


def test_select_model_features_and_consistency(spark):
    from vitalframe.operators.features import select_model_features
    from vitalframe.operators.metrics import check_feature_consistency, feature_consistency
    df = spark.createDataFrame([(1, 50, 120, 0)], "id long, age_years long, ap_hi long, cardio long")
    assert select_model_features(df, keep=("id",)).columns == ["id", "age_years", "ap_hi", "cardio"]
    with pytest.raises(ValueError):
        select_model_features(df.select("id"))
    assert feature_consistency(["a", "b"], ["b", "c"]) == {"missing": ["a"], "extra": ["c"]}
    with pytest.raises(ValueError):
        check_feature_consistency(["a"], ["b"])


def test_optional_range_rules_and_threshold(spark):
    from vitalframe.operators.clean import filter_ranges
    from vitalframe.operators.score import LinearRiskModel
    rows = [(1, 30000, 1, 170, 70.0, 120, 80, 1, 1, 0, 0, 1, 0)]
    df = raw_frame(spark, rows).withColumn("age_years", F.lit(50).cast("long"))
    assert filter_ranges(df).count() == 1
    assert filter_ranges(df, extra_rules=("age_days",)).count() == 0
    m = LinearRiskModel(0.0, {"ap_hi": 0.0}, threshold=0.4)
    assert df.select(m.prediction()).first()[0] == 1   # p = 0.5 > 0.4


def test_tuned_estimator_uses_best_params():
    from vitalframe.operators import models as ml
    est = ml.tuned_estimator("Random_Forest", {"n_estimators": 7, "max_depth": 25, "min_samples_leaf": 2, "min_samples_split": 4})
    assert est.getNumTrees() == 7 and est.getMaxDepth() == 25 and est.getMinInstancesPerNode() == 2


def test_string_statistics_top_ties_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "g string")
    r = P.string_statistics(df).first()
    assert (r["count"], r["unique"], r["top"], r["freq"], r["missing_count"]) == (5, 3, "a", 2, 1)


def test_improvement_against_previous_runs(spark):
    from vitalframe.operators import models as ml
    cur = ml.runs_rows(spark, "new", "XGBoost", {}, {"roc_auc": 0.82}, "test")
    old = ml.runs_rows(spark, "old", "XGBoost", {}, {"roc_auc": 0.80}, "test")
    r = ml.improvement(cur, previous_runs=old).first()
    assert r.previous_auc == 0.80 and r.improvement_pct == pytest.approx(2.5, abs=1e-6)
    assert ml.improvement(cur).first().previous_auc == ml.PREVIOUS_MODEL_AUC


def test_nan_is_missing_and_integers_are_exact(spark):
    from vitalframe.operators import profile as P
    df = spark.createDataFrame([(1.0, 1234567890123457), (float("nan"), 1234567890123458), (3.0, 1234567890123459)], "weight double, id long")
    assert {r.column: r.missing_count for r in P.missing_values(df).collect()} == {"weight": 1, "id": 0}
    stats = {r.column: r for r in P.column_statistics(df).collect()}
    w, i = stats["weight"], stats["id"]
    assert (w["count"], w["mean"], w["missing_count"], w["max"]) == (2, 2.0, 1, 3.0)
    assert (i.unique_count, i.min_whole, i.max_whole) == (3, 1234567890123457, 1234567890123459)
    big = spark.range(2**53, 2**53 + 100).select(F.col("id"))
    assert P.column_statistics(big).first().unique_count == 100
    tiny = spark.createDataFrame([(1e-8,), (1.0,)], "x double")
    assert P.column_statistics(tiny).first()["min"] == 1e-8


def test_quality_limits_compare_full_precision(spark):
    from vitalframe.operators import profile as P
    # 4.99999996 % missing: below 5, though it rounds to 5.000000
    n, gone = 25_000_000, 1_249_999
    df = spark.range(n).select(F.when(F.col("id") >= gone, 1.0).alias("x"))
    rows = {r.check: r for r in P.quality_report(df, {"x": [1]}).collect()}
    assert rows["missing_values"].passed and rows["missing_values"].value < 5


def test_schema_errors_name_every_kind(spark):
    from vitalframe.operators import profile as P
    rows = [(1, 1, 1, 170, None, "x", 80, 1, 1, 0, 0, 1)]
    df = spark.createDataFrame(rows, "id long, age long, gender long, height long, weight double, ap_hi string, ap_lo long, cholesterol long, gluc long, smoke long, alco long, active long")
    got = sorted((r.check, r.column) for r in P.schema_errors(df).collect())
    assert got == [("empty_column", "weight"), ("missing_column", "cardio"), ("non_numeric", "ap_hi")]
    assert tuple(P.schema_verdict(df).first()) == (False, 3)


def test_exact_splits_keep_rows_with_null_keys_and_split_copies(spark):
    rows = [(None if i % 5 == 0 else i, None if i % 4 == 0 else i % 2) for i in range(100)] + [(7, 1)] * 60
    df = spark.createDataFrame(rows, "id long, cardio long")
    assert S.train_val_test_split_exact(df).count() == S.kfold(df, exact=True).count() == 160
    per = {(r.cardio, r.fold): r["count"] for r in S.kfold(df, k=4, exact=True).groupBy("cardio", "fold").count().collect()}
    for label in (None, 0, 1):
        sizes = [per[label, f] for f in range(4)]
        assert max(sizes) - min(sizes) <= 1
    assert S.kfold(df).where("fold is null").count() == 0
