"""Model fits (quality floor, save/load), streaming vs batch, I/O round trips."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from vitalframe.operators import metrics as ev
from vitalframe.operators import models as ml
from vitalframe.operators import score as sc
from vitalframe.operators import split as sp
from vitalframe.plans import batch
from vitalframe.session import scratch_dir


@pytest.fixture(scope="module")
def splits(spark):
    return sp.train_val_test_split(batch.featured(spark, SF01)).cache()


def test_registry_rejects_unknown():
    with pytest.raises(ValueError):
        ml.build_estimator("SVM")


def test_logistic_regression_quality_and_save_load(spark, splits):
    b = ml.fit_bundle("Logistic_Regression", splits.where(F.col("split") == "train"))
    test = splits.where(F.col("split") == "test")
    auc = ev.roc_auc(b.score(test)).first()[0]
    assert auc > 0.65
    path = scratch_dir(spark, "model-test")
    b.save(path)
    again = ml.ModelBundle.load(path)
    a = b.score(test).orderBy("id").collect()
    c = again.score(test).orderBy("id").collect()
    assert [r.probability for r in a] == [r.probability for r in c]
    # The fitted LR as pure column arithmetic gives the same probabilities.
    lin = sc.LinearRiskModel.from_spark_lr(b.model, b.features, b.scaler.center, b.scaler.scale)
    d = test.select("id", lin.probability().alias("p")).orderBy("id").collect()
    assert [r.p for r in d] == pytest.approx([r.probability for r in a], abs=1e-9)


def test_training_summary_and_importance(spark, splits):
    small = {"Random_Forest": {"n_estimators": 5, "max_depth": 4},
             "Gradient_Boosting": {"n_estimators": 5, "max_depth": 3},
             "XGBoost": {"n_estimators": 5, "max_depth": 3}}
    bundles, metrics = ml.train_and_evaluate(splits, params=small)
    summ = ml.training_summary(metrics).collect()
    assert len(summ) == 4 and sum(r.is_best for r in summ) == 1
    assert summ[0].is_best and summ[0].roc_auc == max(r.roc_auc for r in summ)
    imp = ml.feature_importance(bundles["Gradient_Boosting"]).collect()
    assert [r.importance for r in imp] == sorted([r.importance for r in imp], reverse=True)
    assert ml.feature_importance(bundles["Logistic_Regression"]) is None


def test_cross_validation_fold_scores(spark):
    f = batch.featured(spark, "/root/testdata/sf0.001")
    fs = ml.cross_validate(f, ["Logistic_Regression"], k=3)
    summ = {r.metric: r for r in ml.cv_summary(fs).collect()}
    assert len(summ["roc_auc"].scores) == 3
    assert "+/-" in summ["roc_auc"].ci_95


def test_random_search_is_seeded():
    assert ml.sample_params("XGBoost", 3, seed=1) == ml.sample_params("XGBoost", 3, seed=1)
    for p in ml.sample_params("Gradient_Boosting", 20):
        assert 0.01 <= p["learning_rate"] <= 0.3 and 3 <= p["max_depth"] <= 10


def test_stream_equals_batch(spark):
    from vitalframe.streaming.scoring import run_to_completion
    reqs = sc.requests_from_patients(batch.raw_patients(spark, "/root/testdata/sf0.001"))
    src = scratch_dir(spark, "stream-test-in")
    reqs.repartition(3).write.json(src)
    out = run_to_completion(spark, src, scratch_dir(spark, "stream-test-out"),
                            scratch_dir(spark, "stream-test-ckpt"), max_files_per_trigger=1)
    from vitalframe.sources.io import read_requests
    batch_out = sc.score_requests(read_requests(spark, src))
    cols = ["request_id", "status", "probability", "risk_level", "summary"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, batch_out.select(cols).collect()))


def test_csv_round_trip_and_corrupt_lines(spark, tmp_path):
    from vitalframe.schema import RAW_SCHEMA
    from vitalframe.sources import io as sio
    raw = batch.raw_patients(spark, "/root/testdata/sf0.001")
    path = scratch_dir(spark, "csv-test")
    sio.write_delimited(raw, path, sep=";")
    back = sio.read_delimited(spark, path, RAW_SCHEMA, sep=";")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, raw.collect()), key=str)
    bad = tmp_path / "bad.csv"
    bad.write_text("id;age;gender;height;weight;ap_hi;ap_lo;cholesterol;gluc;smoke;alco;active;cardio\n"
                   "1;18000;1;170;70.5;120;80;1;1;0;0;1;0\n2;x;1;170;70;120;80;1;1;0;0;1;0\n")
    rows = sio.read_delimited(spark, str(bad), RAW_SCHEMA, keep_corrupt=True).orderBy("id").collect()
    assert rows[0]["_corrupt_record"] is None and rows[1]["_corrupt_record"] is not None


def test_batch_pipeline_end_to_end(spark):
    from vitalframe.operators.clean import clean
    out = batch.run_batch_pipeline(
        spark, "/root/testdata/sf0.001", scratch_dir(spark, "pipeline-test"),
        model_names=["Logistic_Regression", "Gradient_Boosting"],
        model_params={"Gradient_Boosting": {"n_estimators": 5, "max_depth": 3}}, raw_format="csv")
    p = out["paths"]
    assert out["best_model"] in ("Logistic_Regression", "Gradient_Boosting")
    cleaned = spark.read.parquet(p["clean"])
    direct = batch.raw_patients(spark, "/root/testdata/sf0.001").transform(clean)
    assert sorted(map(tuple, cleaned.collect())) == sorted(map(tuple, direct.collect()))
    rep = {(r.step, r.rule): r.rows for r in spark.read.json(p["cleaning_report"]).collect()}
    assert rep[("final_shape", "rows")] == cleaned.count()
    loaded = ml.ModelBundle.load(p["model"])
    assert loaded.name == out["best_model"]
    assert 0.0 <= out["test_metrics"]["roc_auc"] <= 1.0


def test_importance_rows_for_runs_table(spark, splits):
    b = ml.fit_bundle("Gradient_Boosting", splits.where(F.col("split") == "train"),
                      params={"n_estimators": 3, "max_depth": 2})
    rows = ml.importance_rows("r1", b).collect()
    assert len(rows) == len(b.features) and all(r.metric.startswith("importance:") for r in rows)
    assert b.scaler.n_rows == splits.where(F.col("split") == "train").count()


def test_fit_input_does_not_follow_the_cluster(splits):
    train = splits.where(F.col("split") == "train")
    feats = ["age_years", "weight", "ap_hi"]
    a = ml.fit_input(train, feats)
    b = ml.fit_input(train.repartition(3), feats)
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == ml.FIT_PARTITIONS
    assert a.rdd.glom().map(lambda x: [tuple(r) for r in x]).collect() == b.rdd.glom().map(lambda x: [tuple(r) for r in x]).collect()


def test_models_of_a_summary_share_one_input(splits, monkeypatch):
    """The rows are dealt out once for all models, and each model is the one that is fitted alone."""
    dealt, whole = [], ml.fit_input
    monkeypatch.setattr(ml, "fit_input", lambda *a, **k: dealt.append(1) or whole(*a, **k))
    small = {"Random_Forest": {"n_estimators": 3, "max_depth": 3}, "XGBoost": {"n_estimators": 3, "max_depth": 3}}
    bundles, _ = ml.train_and_evaluate(splits, names=list(small), params=small)
    assert len(dealt) == 1
    for name, b in bundles.items():
        alone = ml.fit_bundle(name, splits.where(F.col("split") == "train"), params=small[name])
        assert alone.scaler == b.scaler and alone.model.toDebugString.split("\n", 1)[1] == b.model.toDebugString.split("\n", 1)[1]


def test_agreement_writes_only_what_it_reads(spark, monkeypatch):
    from vitalframe.plans import registry
    from vitalframe.schema import MODEL_FEATURES
    written, whole = [], ml.reliable_checkpoint
    monkeypatch.setattr(ml, "reliable_checkpoint", lambda df: written.append(df.columns) or whole(df))
    got = registry.QUERIES["K1_forest_columns_agree"](spark, "/root/testdata/sf0.001")
    assert written == [["id", "split", "cardio", *MODEL_FEATURES]]
    assert got.columns == ["id", "label", "agree"] and got.where("not agree").isEmpty()


def test_unsupported_parameters_raise():
    with pytest.raises(ValueError, match="30"):
        ml.build_estimator("Random_Forest", {"max_depth": 31})
    with pytest.raises(ValueError, match="no parameter"):
        ml.build_estimator("XGBoost", {"gamma": 1})
    assert ml.build_estimator("XGBoost", {"min_child_weight": 7}).getMinInstancesPerNode() == 7
    assert ml.build_estimator("Random_Forest", {"min_samples_split": 20, "min_samples_leaf": 2}).getMinInstancesPerNode() == 10


def test_failed_trials_rank_last(spark, splits, monkeypatch):
    train = splits.where(F.col("split") == "train")
    monkeypatch.setattr(ml, "sample_params", lambda name, n, seed=0: [{"C": 1.0}, {"C": 0.0001, "nonsense": 1}])
    for direction in ("maximize", "minimize"):
        rows = ml.tune(train, "Logistic_Regression", 2, k=2, direction=direction, fit_rows=300).collect()
        assert [r.trial for r in rows] == [0, 1] and rows[0].error is None and "nonsense" in rows[1].error
    monkeypatch.setattr(ml, "cross_validate", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ml.tune(train, "Logistic_Regression", 1, k=2)


def test_retrain_and_evaluate_plans(spark):
    table = batch.featured(spark, "/root/testdata/sf0.001").withColumn("cardio", F.col("cardio"))
    out = batch.retrain(spark, table, scratch_dir(spark, "retrain-test"), ["Logistic_Regression"], grid={"n_estimators": [2, 4], "max_depth": [2]},
                        baseline_folds=2, grid_folds=2, fit_rows=400)
    rows = spark.read.json(out["paths"]["grid"]).collect()
    assert len(rows) == 2 and out["cv_score"] == max(r.cv_auc for r in rows)
    record = spark.read.json(out["paths"]["best_params"]).first()
    assert record.cv_score == out["cv_score"] and 0 <= out["test_metrics"]["roc_auc"] <= 1
    got = {r.metric: r.value for r in batch.evaluate_saved(spark, out["paths"]["model"], out["paths"]["splits"], scratch_dir(spark, "evaluate-test")).collect()}
    assert got["roc_auc"] == pytest.approx(out["test_metrics"]["roc_auc"])
    summary = ml.cv_summary(ml.cross_validate(table, ["Logistic_Regression"], k=2)).collect()
    assert all(r.is_best for r in summary)


def test_runs_are_not_doubled(spark):
    path = scratch_dir(spark, "runs-test")
    rows = ml.runs_rows(spark, "r1", "m", {}, {"roc_auc": 0.5}, "test")
    ml.log_runs(rows, path)
    ml.log_runs(rows, path)
    ml.log_runs(ml.runs_rows(spark, "r2", "m", {}, {"roc_auc": 0.6}, "test"), path)
    assert sorted(r.run_id for r in spark.read.parquet(path).collect()) == ["r1", "r2"]


def test_scoring_without_the_features_raises(splits):
    b = ml.fit_bundle("Logistic_Regression", splits.where(F.col("split") == "train"))
    with pytest.raises(ValueError, match="weight"):
        b.score(splits.drop("weight"))


def test_malformed_request_lines_are_kept_and_rejected(spark, tmp_path):
    from vitalframe.operators.score import score_requests
    from vitalframe.sources import io as sio
    path = tmp_path / "requests"
    path.mkdir()
    good = '{"request_id": 1, "age": 50, "gender": "male", "height": 170, "weight": 70, "ap_hi": 120, "ap_lo": 80, "cholesterol": 1, "gluc": 1, "smoke": 0, "alco": 0, "active": 1}'
    (path / "a.json").write_text(good + "\n{not json\n")
    requests = sio.read_requests(spark, str(path))
    assert sorted((r.request_id, r.malformed) for r in requests.collect() if r.malformed) == [(None, "{not json")]
    assert sorted((r.status, r.rejection) for r in score_requests(requests).collect()) == [("rejected", "malformed"), ("scored", None)]
