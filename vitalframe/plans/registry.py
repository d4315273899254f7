"""Registry of queries: one per operator id of the survey inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame built from the
driver tables (through the patient view over ``orders``, or ``labels``), so the work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from vitalframe.plans import batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


@register("flagship_bp_category")
def q_flagship(spark, sf):
    return batch.featured(spark, sf).transform(batch.bp_category_summary)


@register("C9_clean")
def q_clean(spark, sf):
    return batch.cleaned(spark, sf)


@register("F19_features")
def q_features(spark, sf):
    return batch.featured(spark, sf)


# ------------------------------------------------------------------ profiling
from vitalframe.operators import profile as prof  # noqa: E402


@register("V1_dataset_info")
def q_v1(spark, sf):
    return prof.dataset_info(batch.raw_patients(spark, sf))


@register("V2_missing_values")
def q_v2(spark, sf):
    return prof.missing_values(batch.raw_patients(spark, sf))


@register("V3_duplicates")
def q_v3(spark, sf):
    return prof.duplicate_stats(batch.raw_patients(spark, sf))


@register("V4_V6_schema_errors")
def q_v4(spark, sf):
    return prof.schema_errors(batch.raw_patients(spark, sf))


@register("V7_schema_verdict")
def q_v7(spark, sf):
    return prof.schema_verdict(batch.raw_patients(spark, sf))


@register("V8_V11_quality_report")
def q_v8(spark, sf):
    return prof.quality_report(batch.raw_patients(spark, sf))


@register("V10_categorical_values")
def q_v10v(spark, sf):
    return prof.categorical_values(batch.raw_patients(spark, sf))


@register("V10_categorical_checks")
def q_v10(spark, sf):
    return prof.categorical_checks(batch.raw_patients(spark, sf))


@register("V12_column_statistics")
def q_v12(spark, sf):
    return prof.column_statistics(batch.raw_patients(spark, sf))


@register("V13_clean_describe")
def q_v13(spark, sf):
    return prof.column_statistics(batch.cleaned(spark, sf))


@register("V14_value_distributions")
def q_v14(spark, sf):
    return prof.value_distributions(batch.cleaned(spark, sf))


@register("V15_raw_expectations")
def q_v15(spark, sf):
    return prof.raw_expectations(batch.raw_patients(spark, sf))


@register("V16_cleaned_expectations")
def q_v16(spark, sf):
    return prof.cleaned_expectations(batch.cleaned(spark, sf))


from vitalframe.operators import clean as cln  # noqa: E402


@register("C8_rejection_report")
def q_c8(spark, sf):
    return cln.rejection_report(batch.raw_patients(spark, sf))


# ------------------------------------------------------------------ splits
from pyspark.sql import functions as F  # noqa: E402

from vitalframe.functions.rounding import r6  # noqa: E402
from vitalframe.operators import metrics as ev  # noqa: E402
from vitalframe.operators import score as sc  # noqa: E402
from vitalframe.operators import split as sp  # noqa: E402
from vitalframe.schema import MODEL_FEATURES  # noqa: E402


def _counts(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


@register("P1_split_counts")
def q_p1(spark, sf):
    return _counts(sp.train_val_test_split(batch.featured(spark, sf)), "split", "cardio")


@register("P1_exact_split_counts")
def q_p1x(spark, sf):
    return _counts(sp.train_val_test_split_exact(batch.featured(spark, sf)), "split", "cardio")


@register("P2_train_test_counts")
def q_p2(spark, sf):
    return _counts(sp.train_test_split(batch.featured(spark, sf)), "split", "cardio")


@register("P3_kfold_counts")
def q_p3(spark, sf):
    return _counts(sp.kfold(batch.featured(spark, sf)), "fold", "cardio")


@register("P3_kfold_exact_counts")
def q_p3x(spark, sf):
    return _counts(sp.kfold(batch.featured(spark, sf), exact=True), "fold", "cardio")


def _with_holes(spark, sf):
    """Raw patients with every 7th id and every 5th label null: null keys must keep their rows."""
    raw = batch.raw_patients(spark, sf)
    return raw.withColumns({"cardio": F.when(F.col("id") % 5 != 0, F.col("cardio")), "id": F.when(F.col("id") % 7 != 0, F.col("id"))})


@register("P1_split_rows")
def q_p1r(spark, sf):
    return sp.train_val_test_split(batch.featured(spark, sf)).select("id", "split")


@register("P1_exact_split_rows")
def q_p1xr(spark, sf):
    return sp.train_val_test_split_exact(batch.featured(spark, sf)).select("id", "split")


@register("P2_train_test_rows")
def q_p2r(spark, sf):
    return sp.train_test_split(batch.featured(spark, sf)).select("id", "split")


@register("P3_kfold_rows")
def q_p3r(spark, sf):
    return sp.kfold(batch.featured(spark, sf)).select("id", "fold")


@register("P3_kfold_exact_rows")
def q_p3xr(spark, sf):
    return sp.kfold(batch.featured(spark, sf), exact=True).select("id", "fold")


@register("P1_exact_split_null_keys")
def q_p1n(spark, sf):
    return _counts(sp.train_val_test_split_exact(_with_holes(spark, sf)), "split", "cardio")


@register("P3_kfold_exact_null_keys")
def q_p3n(spark, sf):
    return _counts(sp.kfold(_with_holes(spark, sf), exact=True), "fold", "cardio")


def _scaled(spark, sf, fit):
    s = sp.train_val_test_split(batch.featured(spark, sf))
    model = fit(s.where(F.col("split") == "train"), MODEL_FEATURES)
    out = model.transform(s.where(F.col("split") == "test"), MODEL_FEATURES)
    return out.select("id", *[r6(F.col(c)).alias(c) for c in MODEL_FEATURES], "cardio")


@register("P4_standard_scaling")
def q_p4(spark, sf):
    return _scaled(spark, sf, sp.fit_standard_scaler)


@register("D3_minmax_scaling")
def q_d3(spark, sf):
    return _scaled(spark, sf, sp.fit_minmax_scaler)


# ------------------------------------------------------------------ evaluation

def scored_splits(spark, sf):
    """Fixed linear risk score over the featured table, with the hash split."""
    s = sp.train_val_test_split(batch.featured(spark, sf))
    return sc.score_table(s, keep=("split",))


def scored_test(spark, sf):
    return scored_splits(spark, sf).where(F.col("split") == "test").drop("split")


@register("E1_E2_E4_metrics_by_split")
def q_e1(spark, sf):
    return ev.basic_metrics(scored_splits(spark, sf), ["split"])


@register("E2_roc_auc_test")
def q_e2(spark, sf):
    return ev.roc_auc(scored_test(spark, sf), constant_score_auc=None)


@register("E3_confusion_matrix_by_split")
def q_e3(spark, sf):
    return ev.confusion_matrix(scored_splits(spark, sf), ["split"])


@register("E5_classification_report_test")
def q_e5(spark, sf):
    return ev.classification_report(scored_test(spark, sf))


@register("E6_calibration_bins_test")
def q_e6b(spark, sf):
    b = ev.calibration_bins(scored_test(spark, sf))
    return b.select("bin", r6(F.col("mean_predicted")).alias("mean_predicted"),
                    r6(F.col("observed_rate")).alias("observed_rate"), "count")


@register("E6_E8_reliability_test")
def q_e6(spark, sf):
    return ev.reliability_metrics(scored_test(spark, sf))


@register("E9_threshold_sweep_test")
def q_e9(spark, sf):
    return ev.threshold_sweep(scored_test(spark, sf))


@register("E10_evaluation_bundle_test")
def q_e10(spark, sf):
    return ev.evaluation_bundle(scored_test(spark, sf))


@register("E13_train_validation_report")
def q_e13(spark, sf):
    s = scored_splits(spark, sf).where(F.col("split").isin("train", "validation"))
    return ev.classification_report(s, ["split"])


# ------------------------------------------------------------------ scoring

def requests(spark, sf):
    return sc.requests_from_patients(batch.raw_patients(spark, sf))


def responses(spark, sf):
    return sc.score_requests(requests(spark, sf))


@register("K1_score_requests")
def q_k1(spark, sf):
    r = responses(spark, sf)
    return r.withColumn("probability", r6(F.col("probability")))


@register("K5_prediction_reports_test")
def q_k5(spark, sf):
    rep = sc.prediction_reports(scored_test(spark, sf))
    return rep.select("id", F.col("report").withField("probability", r6(F.col("report.probability")))
                      .alias("report"))


@register("K9_K16_assessment")
def q_k9(spark, sf):
    a = sc.assessment(responses(spark, sf))
    return a.withColumn("probability", r6(F.col("probability")))


@register("K10_K12_assessment_v1")
def q_k10(spark, sf):
    a = sc.assessment(responses(spark, sf), variant="v1")
    return a.withColumn("probability", r6(F.col("probability")))


@register("K18_what_if")
def q_k18(spark, sf):
    return sc.what_if(requests(spark, sf))


@register("K19_report_highlights")
def q_k19(spark, sf):
    return sc.report_highlights(sc.assessment(responses(spark, sf)))


@register("S10_text_report")
def q_s10(spark, sf):
    return sc.text_report(responses(spark, sf), generated_at=F.lit("2025-01-01 00:00"))


# ------------------------------------------------------------------ models (rows-only)
from vitalframe.operators import models as ml  # noqa: E402

from vitalframe.operators import newton  # noqa: E402
from vitalframe.operators import search  # noqa: E402
from vitalframe.operators import tree_score as ts  # noqa: E402
from vitalframe.operators import trees  # noqa: E402

# All searches are registered whole: the settings of ``models.MODEL_CONFIG``, every point
# of ``models.RETRAIN_GRID``, 50 trials of each model. Their labelled rows are a hash sample
# of about CV_ROWS and ``search.FIT_ROWS`` rows (the tables of the searches name the number).
CV_ROWS = 8000

def splits(spark, sf):
    return sp.train_val_test_split(batch.featured(spark, sf))


@register("M6_M7_M10_M11_training_summary")
def q_m11(spark, sf):
    _, metrics = ml.train_and_evaluate(splits(spark, sf))
    return ml.training_summary(metrics)


@register("M8_M9_cross_validation")
def q_m8(spark, sf):
    fs = search.cross_validate(batch.featured(spark, sf), k=5, fit_rows=CV_ROWS)
    return ml.cv_summary(fs)


def _folded(spark, sf):
    return ml.reliable_checkpoint(sp.kfold(batch.featured(spark, sf), exact=True))


@register("M8_logistic_folds_all_rows")
def q_m8_all(spark, sf):
    return newton.cross_validate_logistic(_folded(spark, sf), [0.01, 0.1, 1.0, 10.0])


@register("M2_logistic_folds_at_optimum")
def q_m2(spark, sf):
    folded = _folded(spark, sf)
    found = newton.gradients(folded, newton.fit_folds(folded, MODEL_FEATURES, [0.1, 1.0]))
    return found.select("c", "fold", "train_rows", (F.col("worst") < 1e-8).alias("at_optimum"))


@register("M12_grid_search")
def q_m12(spark, sf):
    train = splits(spark, sf).where(F.col("split") == "train")
    _, _, table = search.grid_search(train, folds=3)
    return table


@register("M13_M14_random_search")
def q_m14(spark, sf):
    train = splits(spark, sf).where(F.col("split") == "train")
    return search.tune_all(train, n_trials=50, k=3)


@register("M18_feature_importance")
def q_m18(spark, sf):
    s = splits(spark, sf)
    b = ml.fit_bundle("XGBoost", s.where(F.col("split") == "train"))
    return ml.feature_importance(b)


@register("E12_best_model_test_evaluation")
def q_e12(spark, sf):
    s = ml.reliable_checkpoint(splits(spark, sf))  # read by the fit and by the scoring
    b = ml.fit_bundle("Logistic_Regression", s.where(F.col("split") == "train"))
    scored = b.score(s.where(F.col("split") == "test"), keep=("id",))
    return ev.basic_metrics(scored)


@register("K1_fitted_model_scoring")
def q_k1m(spark, sf):
    s = splits(spark, sf)
    b = ml.fit_bundle("Logistic_Regression", s.where(F.col("split") == "train"))
    lin = sc.LinearRiskModel.from_spark_lr(b.model, b.features, b.scaler.center, b.scaler.scale)
    return sc.score_requests(requests(spark, sf), model=lin)


@register("M17_improvement")
def q_m17(spark, sf):
    s = ml.reliable_checkpoint(splits(spark, sf))  # read by the fit and by the scoring
    b = ml.fit_bundle("Logistic_Regression", s.where(F.col("split") == "train"))
    m = ev.basic_metrics(b.score(s.where(F.col("split") == "test"), keep=("id",))).first().asDict()
    runs = ml.runs_rows(spark, "run-1", b.name, b.params, m, "test")
    return ml.improvement(runs)


# ------------------------------------------------------------------ options D1 / D2 / D7
from vitalframe.operators import outliers as ol  # noqa: E402
from vitalframe.operators.features import bp_profile_skew  # noqa: E402


@register("D1_iqr_outlier_filter")
def q_d1(spark, sf):
    c = batch.cleaned(spark, sf)
    return ol.filter_iqr(c, ol.iqr_bounds(c))


@register("D2_zscore_outlier_filter")
def q_d2(spark, sf):
    c = batch.cleaned(spark, sf)
    return ol.filter_zscore(c, ol.zscore_bounds(c))


@register("D7_reference_bands")
def q_d7(spark, sf):
    f = ol.with_reference_bands(batch.featured(spark, sf))
    return _counts(f, "bmi_who_class", "age_band", "bp_band")


@register("F7_F8_bp_profile_skew")
def q_skew(spark, sf):
    return bp_profile_skew(batch.cleaned(spark, sf))


# ------------------------------------------------------------------ requests C11 - C14
@register("C11_C12_request_routing")
def q_c11(spark, sf):
    return _counts(responses(spark, sf), "status", "rejection")


def form_inputs(raw):
    """Stand-in form submissions: codes shown as the form's labels and answers."""
    inv_chol = {v: k for k, v in cln.CHOLESTEROL_LABELS.items()}
    inv_gluc = {v: k for k, v in cln.GLUCOSE_LABELS.items()}

    def to_map(d):
        return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])

    yn = lambda c: F.when(F.col(c) == 1, "Yes").otherwise("No")
    g = F.when(F.col("gender") == 2, F.when(F.col("id") % 2 == 0, " Male ").otherwise("m")) \
        .otherwise(F.when(F.col("id") % 2 == 0, "Female").otherwise("f"))
    return raw.select("id", g.alias("gender"),
                      to_map(inv_chol)[F.col("cholesterol")].alias("cholesterol"),
                      to_map(inv_gluc)[F.col("gluc")].alias("gluc"),
                      yn("smoke").alias("smoke"), yn("alco").alias("alco"), yn("active").alias("active"))


@register("C13_C14_form_codes")
def q_c13(spark, sf):
    from vitalframe.functions.clinical import gender_code
    f = form_inputs(batch.raw_patients(spark, sf))
    return f.select("id", gender_code("gender").alias("gender"),
                    cln.label_code("cholesterol", cln.CHOLESTEROL_LABELS).alias("cholesterol"),
                    cln.label_code("gluc", cln.GLUCOSE_LABELS).alias("gluc"),
                    cln.yes_no_code("smoke").alias("smoke"), cln.yes_no_code("alco").alias("alco"),
                    cln.yes_no_code("active").alias("active"))


# ------------------------------------------------------------------ sources / sinks
from vitalframe.session import scratch_dir  # noqa: E402
from vitalframe.sources import io as sio  # noqa: E402
from vitalframe.schema import RAW_SCHEMA  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

CLEAN_SCHEMA = T.StructType([T.StructField(f.name, f.dataType, True) for f in RAW_SCHEMA.fields]
                            + [T.StructField("age_years", T.LongType(), True)])


@register("S1_S3_delimited_round_trip")
def q_s1(spark, sf):
    path = scratch_dir(spark, "raw_csv")
    sio.write_delimited(batch.raw_patients(spark, sf), path, sep=";")
    return sio.read_delimited(spark, path, RAW_SCHEMA, sep=";")


@register("S2_stage_csv_round_trip")
def q_s2(spark, sf):
    path = scratch_dir(spark, "clean_csv")
    sio.write_delimited(batch.cleaned(spark, sf), path, sep=",")
    return sio.read_delimited(spark, path, CLEAN_SCHEMA, sep=",")


@register("S4_S5_saved_test_split")
def q_s4(spark, sf):
    path = scratch_dir(spark, "splits")
    sio.write_splits(splits(spark, sf), path, MODEL_FEATURES)
    return sio.read_split(spark, path, "test")


@register("S6_C11_json_requests")
def q_s6(spark, sf):
    path = scratch_dir(spark, "requests_json")
    sio.write_requests(requests(spark, sf), path)
    r = sio.read_requests(spark, path)
    return cln.validate_requests(r).select("request_id", "rejection")


def _streamed(spark, sf, model):
    from vitalframe.streaming.scoring import run_to_completion
    src = scratch_dir(spark, "stream_in")
    # Arriving request files: one per shuffle partition (sized to the data on a
    # cluster), hash-placed by request id so files are even and a retried task
    # writes the same rows; the stream takes them in about four micro-batches.
    n_files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    requests(spark, sf).repartition(n_files, "request_id").write.json(src)
    out = run_to_completion(spark, src, scratch_dir(spark, "stream_out"),
                            scratch_dir(spark, "stream_ckpt"), model,
                            max_files_per_trigger=max(1, -(-n_files // 4)))
    return out.withColumn("probability", r6(F.col("probability")))


@register("K20_streaming_scoring")
def q_k20(spark, sf):
    return _streamed(spark, sf, sc.DEFAULT_RISK_MODEL)


@register("S7_model_save_load")
def q_s7(spark, sf):
    s = splits(spark, sf)
    b = ml.fit_bundle("Logistic_Regression", s.where(F.col("split") == "train"))
    path = scratch_dir(spark, "model")
    b.save(path)
    return ml.ModelBundle.load(path).score(s.where(F.col("split") == "test"), keep=("id",))


@register("S8_S9_best_params_and_runs")
def q_s8(spark, sf):
    s = splits(spark, sf)
    b = ml.fit_bundle("Logistic_Regression", s.where(F.col("split") == "train"))
    m = ev.basic_metrics(b.score(s.where(F.col("split") == "test"), keep=("id",))).first().asDict()
    sio.write_json_record(ml.best_params_record(spark, b.name, ml.MODEL_CONFIG[b.name], None, m),
                          scratch_dir(spark, "best_params"))
    runs = scratch_dir(spark, "runs")
    ml.log_runs(ml.runs_rows(spark, "run-1", b.name, b.params, m, "test"), runs)
    ml.log_runs(ml.runs_rows(spark, "run-2", b.name, b.params, m, "test"), runs)
    return spark.read.parquet(runs).drop("logged_at")


# ------------------------------------------------------------------ cleaning steps C1 - C6
@register("C1_remove_duplicates")
def q_c1(spark, sf):
    return cln.remove_duplicates(batch.raw_patients(spark, sf))


@register("C2_age_in_years")
def q_c2(spark, sf):
    return cln.convert_age_to_years(batch.raw_patients(spark, sf)).select("id", "age", "age_years")


@register("C3_categorical_filter")
def q_c3(spark, sf):
    return cln.filter_categorical(batch.raw_patients(spark, sf))


@register("C4_range_filter")
def q_c4(spark, sf):
    return cln.filter_ranges(cln.convert_age_to_years(batch.raw_patients(spark, sf)))


@register("C5_bp_anomaly_filter")
def q_c5(spark, sf):
    return cln.filter_bp_anomalies(batch.raw_patients(spark, sf))


@register("C6_drop_missing")
def q_c6(spark, sf):
    return cln.drop_missing(batch.raw_patients(spark, sf))


@register("V12_string_statistics")
def q_v12s(spark, sf):
    return prof.string_statistics(requests(spark, sf))


# ------------------------------------------------------------------ second label table
LABEL_DOMAINS = {"quality": [0, 1], "toxic": [0, 1]}


def label_table(spark, sf):
    from vitalframe.sources.patients import read_table
    return read_table(spark, sf, "labels")


@register("V14_labels_value_distributions")
def q_v14l(spark, sf):
    return prof.value_distributions(label_table(spark, sf), ["quality", "toxic"])


@register("V10_labels_categorical_checks")
def q_v10l(spark, sf):
    return prof.categorical_checks(label_table(spark, sf), LABEL_DOMAINS)


@register("V12_labels_column_statistics")
def q_v12l(spark, sf):
    return prof.column_statistics(label_table(spark, sf))


# ------------------------------------------------------------------ model tables on fixed-coefficient scores
def two_models(spark, sf, of=("train", "validation")):
    """Scores of two fixed models over some splits, as the fitted ones deliver them."""
    linear = scored_splits(spark, sf).where(F.col("split").isin(*of)).withColumns({"model": F.lit("linear"), "model_order": F.lit(0)})
    pressure = linear.select("id", "label", "split").join(batch.featured(spark, sf).select("id", "ap_hi"), "id")
    p = F.col("ap_hi") / 250.0
    pressure = pressure.select("id", "label", p.alias("probability"), "split", (p > 0.5).cast("int").alias("prediction"),
                               F.lit("pressure").alias("model"), F.lit(1).alias("model_order"))
    return linear.select(*pressure.columns).unionByName(pressure)


@register("M10_M11_summary_of_fixed_models")
def q_m10_fixed(spark, sf):
    return ml.training_summary(ev.basic_metrics(two_models(spark, sf), ["model", "model_order", "split"]))


def fixed_runs(spark, sf):
    """Runs-table rows (S9) of the fixed model's test metrics."""
    m = ev.basic_metrics(scored_test(spark, sf)).first().asDict()
    return ml.runs_rows(spark, "run-1", "linear", {}, m, "test")


@register("M17_improvement_of_fixed_model")
def q_m17_fixed(spark, sf):
    return ml.improvement(fixed_runs(spark, sf))


@register("S9_run_log_of_fixed_model")
def q_s9_fixed(spark, sf):
    runs = scratch_dir(spark, "runs")
    rows = fixed_runs(spark, sf)
    ml.log_runs(rows, runs)
    ml.log_runs(rows, runs)  # a retried stage replaces its own rows
    return spark.read.parquet(runs).select("run_id", "stage", "model", "metric", "value")


@register("S8_best_params_of_fixed_model")
def q_s8_fixed(spark, sf):
    path = scratch_dir(spark, "best_params")
    m = ev.basic_metrics(scored_test(spark, sf)).first().asDict()
    sio.write_json_record(ml.best_params_record(spark, "linear", {"depth": 5}, m["roc_auc"], m), path)
    record = spark.read.schema("model_name string, params string, cv_score double, test_metrics map<string,double>").json(path)
    return record.select("model_name", "params", "cv_score", F.col("test_metrics")["accuracy"].alias("accuracy"), F.col("test_metrics")["f1_score"].alias("f1_score"))


@register("S7_saved_model_scores_agree")
def q_s7_agree(spark, sf):
    s = splits(spark, sf)
    b = ml.fit_bundle("Logistic_Regression", s.where(F.col("split") == "train"))
    path = scratch_dir(spark, "model")
    b.save(path)
    test = s.where(F.col("split") == "test")
    again = ml.ModelBundle.load(path).score(test, keep=("id",)).select("id", F.col("probability").alias("p"), F.col("prediction").alias("c"))
    both = b.score(test, keep=("id",)).join(again, "id")
    return both.select("id", "label", ((F.col("p") == F.col("probability")) & (F.col("c") == F.col("prediction"))).alias("agree"))


@register("K1_fitted_model_routing")
def q_k1_routing(spark, sf):
    return _counts(q_k1m(spark, sf), "status", "rejection")


@register("M12_fold_sizes_of_search")
def q_m12_folds(spark, sf):
    train = sp.train_test_split(batch.featured(spark, sf)).where(F.col("split") == "train")
    return _counts(sp.kfold(train, k=3, exact=True), "fold", "cardio")


@register("M16_baseline_cross_validation")
def q_m16(spark, sf):
    train = sp.train_test_split(batch.featured(spark, sf)).where(F.col("split") == "train")
    return ml.cv_summary(search.cross_validate(train, k=5, params=ml.RETRAIN_BASELINE, fit_rows=CV_ROWS))


@register("M12_M17_retrain_and_evaluate")
def q_retrain(spark, sf):
    """The whole retrain path, then the evaluation of the model that it has saved."""
    done = batch.retrain(spark, batch.featured(spark, sf), scratch_dir(spark, "retrain"))
    return batch.evaluate_saved(spark, done["paths"]["model"], done["paths"]["splits"], scratch_dir(spark, "evaluate"))


@register("M17_previous_run_as_of")
def q_m17_as_of(spark, sf):
    """Events stand in for runs: by type, at the hour, so that many share an instant."""
    runs = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("model"), F.date_trunc("hour", "ts").alias("logged_at"), "value")
    return ml.previous_runs_as_of(runs)


@register("D7_bands_from_a_table")
def q_d7_table(spark, sf):
    bands = spark.createDataFrame([("low", None, 18.5), ("mid", 20.0, 25.0), ("high", 24.0, 30.0), ("very high", 32.5, None)], "name string, low double, high double")
    return _counts(ol.with_band(batch.featured(spark, sf), "bmi", bands), "band")


@register("D9_predictions_at_thresholds")
def q_d9(spark, sf):
    rows = scored_test(spark, sf)
    at = [replace(sc.DEFAULT_RISK_MODEL, threshold=t).prediction(F.col("probability")).alias(f"p{i}") for i, t in enumerate((0.35, 0.5, 0.65))]
    return _counts(rows.select("label", *at), "label", "p0", "p1", "p2")


@register("E11_missing_features_of_tables")
def q_e11(spark, sf):
    """Features that the saved model needs and a table lacks, with the table's rows: raw, cleaned and featured patients."""
    out = None
    for name, df in (("raw", batch.raw_patients(spark, sf)), ("cleaned", batch.cleaned(spark, sf)), ("featured", batch.featured(spark, sf))):
        diff = ev.feature_consistency(MODEL_FEATURES, [c for c in df.columns if c in MODEL_FEATURES])
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), F.lit(len(diff["missing"])).alias("n_missing"), F.array(*map(F.lit, diff["missing"])).cast("array<string>").alias("missing"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@register("E12_best_fixed_model_on_test")
def q_e12_fixed(spark, sf):
    """E12 with fixed models: the best of the summary, evaluated on the test split."""
    best = ml.select_best(ml.training_summary(ev.basic_metrics(two_models(spark, sf), ["model", "model_order", "split"])))
    return ev.basic_metrics(two_models(spark, sf, ("test",)).where(F.col("model") == best), ["model"])


# ------------------------------------------------------------------ tree models as columns
@register("K1_tree_model_scoring")
def q_k1_tree(spark, sf):
    scored = sc.score_requests(requests(spark, sf), model=ts.DEFAULT_TREE_MODEL)
    return scored.withColumn("probability", r6(F.col("probability")))


@register("K18_tree_model_what_if")
def q_k18_tree(spark, sf):
    return sc.what_if(requests(spark, sf), model=ts.DEFAULT_TREE_MODEL)


@register("K20_tree_model_streaming")
def q_k20_tree(spark, sf):
    return _streamed(spark, sf, ts.DEFAULT_TREE_MODEL)


def _agreement(scored, again, label="cardio"):
    """Whether two scorings of the same ids give one probability."""
    both = scored.join(again, "id")
    return both.select("id", F.col("label").cast("int").alias("label"), (F.abs(F.col("p") - F.col("probability")) < 1e-12).alias("agree"))


@register("K1_forest_columns_agree")
def q_k1_forest_agree(spark, sf):
    s = ml.reliable_checkpoint(ml.fit_columns(splits(spark, sf)))
    b = ml.fit_bundle("Random_Forest", s.where(F.col("split") == "train"), params={"n_estimators": 20, "max_depth": 8})
    test = s.where(F.col("split") == "test")
    return _agreement(b.score(test, keep=("id",)), test.select("id", ts.TreeRiskModel.from_spark(b).probability().alias("p")))


@register("K1_boosted_columns_agree")
def q_k1_boosted_agree(spark, sf):
    s = ml.reliable_checkpoint(splits(spark, sf))
    model = search.refit(s.where(F.col("split") == "train"), {})
    test = s.where(F.col("split") == "test").withColumnRenamed("cardio", "label")
    return _agreement(trees.score_boosted(test, model, keep=("id", "label")), test.select("id", ts.TreeRiskModel.from_boosted(model).probability().alias("p")))


# ------------------------------------------------------------------ operators checked on their own
@register("C10_model_columns")
def q_c10(spark, sf):
    from vitalframe.operators.features import select_model_features
    return select_model_features(batch.featured(spark, sf), keep=("id",))


@register("D5_optional_ranges")
def q_d5(spark, sf):
    from vitalframe.functions import clinical as fx
    rows = cln.convert_age_to_years(batch.raw_patients(spark, sf)).withColumn("bmi", fx.bmi())
    return cln.filter_ranges(rows, extra_rules=("age_days", "bmi")).select("id", "age", "bmi")


def broken_table(spark, sf):
    """Raw patients without a label, with a text column and an empty one."""
    raw = batch.raw_patients(spark, sf)
    return raw.drop("cardio").withColumns({"ap_hi": F.col("ap_hi").cast("string"), "weight": F.lit(None).cast("double")})


@register("V4_V6_broken_table_errors")
def q_v4_broken(spark, sf):
    return prof.schema_errors(broken_table(spark, sf))


@register("V7_broken_table_verdict")
def q_v7_broken(spark, sf):
    return prof.schema_verdict(broken_table(spark, sf))


@register("V2_missing_with_nan")
def q_v2_nan(spark, sf):
    raw = batch.raw_patients(spark, sf)
    return prof.missing_values(raw.withColumn("weight", F.when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("weight"))))


@register("V12_large_integers")
def q_v12_large(spark, sf):
    big = batch.raw_patients(spark, sf).select((F.col("id") + F.lit(2**53)).alias("id"))
    return prof.column_statistics(big).select("column", "count", "unique_count", "min_whole", "max_whole")


# ------------------------------------------------------------------ checked precision
#: Queries whose doubles are rounded to six places for the comparison with SQL; operators return full precision.
ROUNDED = [
    "V1_dataset_info", "V2_missing_values", "V3_duplicates", "V8_V11_quality_report", "V12_column_statistics", "V13_clean_describe",
    "V12_labels_column_statistics", "E1_E2_E4_metrics_by_split", "E2_roc_auc_test", "E5_classification_report_test", "E6_E8_reliability_test",
    "E9_threshold_sweep_test", "E10_evaluation_bundle_test", "E13_train_validation_report", "E12_best_model_test_evaluation",
    "M6_M7_M10_M11_training_summary", "M8_M9_cross_validation", "M8_logistic_folds_all_rows", "M16_baseline_cross_validation", "M12_M17_retrain_and_evaluate", "M17_previous_run_as_of", "E12_best_fixed_model_on_test", "M12_grid_search", "M13_M14_random_search", "M17_improvement", "M10_M11_summary_of_fixed_models",
    "M17_improvement_of_fixed_model", "S9_run_log_of_fixed_model", "S8_best_params_of_fixed_model", "V2_missing_with_nan",
]


def _rounded(query: Query) -> Query:
    def run(spark, sf):
        df = query(spark, sf)
        return df.withColumns({f.name: r6(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})
    return run


QUERIES.update({name: _rounded(QUERIES[name]) for name in ROUNDED})
