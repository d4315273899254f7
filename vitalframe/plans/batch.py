"""Batch plans: the reference's four stages as one lazy DataFrame plan.

ingest -> clean -> features is a single plan; nothing is materialised until
an action (or an explicit write) runs it, so Catalyst sees the whole thing
and pushes filters and projections down to the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.operators.clean import clean
from vitalframe.operators.features import add_features
from vitalframe.functions.rounding import r6
from vitalframe.sources.patients import patients


def raw_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patients(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_patients(spark, sf_dir).transform(clean)


def featured(spark: SparkSession, sf_dir: str, bp_profile: str = "train") -> DataFrame:
    return cleaned(spark, sf_dir).transform(add_features, bp_profile=bp_profile)


def bp_category_summary(df: DataFrame) -> DataFrame:
    """Flagship question: patients, cardio rate and mean age per BP class."""
    return df.groupBy("bp_category").agg(
        F.count(F.lit(1)).alias("patients"),
        r6(F.avg(F.col("cardio").cast("double"))).alias("cardio_rate"),
        r6(F.avg("age_years")).alias("mean_age"),
    )


# ------------------------------------------------------------------ staged run

def clean_with_report(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C8 + C9 from one de-duplicating aggregate, written once to the checkpoint folder."""
    from vitalframe.operators.clean import cleaned_from_tagged, report_from_tagged, tag_distinct_rows
    from vitalframe.session import checkpoint_root
    checkpoint_root(raw.sparkSession)
    tagged = tag_distinct_rows(raw).checkpoint(eager=True)
    return cleaned_from_tagged(tagged), report_from_tagged(tagged)


def run_batch_pipeline(spark: SparkSession, sf_dir: str, out_root: str,
                       model_names: list[str] | None = None,
                       model_params: dict[str, dict] | None = None,
                       raw_format: str = "parquet") -> dict:
    """The four reference stages (ingest, clean, features, train) as Spark jobs.

    Each stage writes its output under ``out_root`` (a shared folder) and the
    next stage reads it back, so a failed stage restarts from the last
    written table rather than from the source. Stage tables are parquet
    (typed, column-pruned reads); ``raw_format="csv"`` keeps the raw table as
    a ';' delimited file instead, like the reference's raw input. Returns
    paths and the chosen model.
    """
    import os

    from vitalframe.operators import metrics as ev
    from vitalframe.operators import models as ml
    from vitalframe.operators import profile as prof
    from vitalframe.operators.split import train_val_test_split
    from vitalframe.schema import MODEL_FEATURES
    from vitalframe.sources import io as sio

    p = {k: os.path.join(out_root, k) for k in (
        "raw", "profile", "quality", "clean", "cleaning_report", "features", "splits",
        "feature_metadata", "training_summary", "test_metrics", "runs", "best_params", "model")}

    # Stage 1: ingest (raw table, profile and quality reports).
    if raw_format == "csv":
        sio.write_delimited(raw_patients(spark, sf_dir), p["raw"], sep=";")
        raw = sio.read_delimited(spark, p["raw"], sep=";")
    else:
        raw_patients(spark, sf_dir).write.mode("overwrite").parquet(p["raw"])
        raw = spark.read.parquet(p["raw"])
    prof.dataset_info(raw).write.mode("overwrite").json(p["profile"])
    prof.quality_report(raw).write.mode("overwrite").json(p["quality"])

    # Stage 2: clean (one de-duplicating pass feeds the table and the report).
    cleaned, report = clean_with_report(raw)
    cleaned.write.mode("overwrite").parquet(p["clean"])
    report.write.mode("overwrite").json(p["cleaning_report"])

    # Stage 3: features.
    spark.read.parquet(p["clean"]).transform(add_features).write.mode("overwrite").parquet(p["features"])

    # Stage 4: split, train, select, evaluate, save.
    featured_df = spark.read.parquet(p["features"])
    sio.write_splits(train_val_test_split(featured_df).select(
        "id", *MODEL_FEATURES, "cardio", "split"), p["splits"], ["id"] + MODEL_FEATURES)
    sio.write_feature_metadata(spark, MODEL_FEATURES, p["feature_metadata"])
    splits_df = spark.read.parquet(p["splits"])
    bundles, metrics = ml.train_and_evaluate(splits_df, model_names, model_params)
    summary = ml.training_summary(metrics)
    summary.write.mode("overwrite").json(p["training_summary"])
    best = ml.select_best(summary)
    bundle = bundles[best]
    test = sio.read_split(spark, p["splits"], "test")
    test_metrics = ev.basic_metrics(bundle.score(test, keep=("id",)))
    test_metrics.write.mode("overwrite").json(p["test_metrics"])
    m = test_metrics.first().asDict()
    run_id = os.path.basename(out_root)
    ml.log_runs(ml.runs_rows(spark, run_id, best, bundle.params, m, "test"), p["runs"])
    imp = ml.importance_rows(run_id, bundle)
    if imp is not None:
        ml.log_runs(imp, p["runs"])
    sio.write_json_record(ml.best_params_record(spark, best, {**ml.MODEL_CONFIG[best], **bundle.params},
                                                None, m), p["best_params"])
    bundle.save(p["model"])
    return {"paths": p, "best_model": best, "test_metrics": m}


def evaluate_saved(spark: SparkSession, model_path: str, splits_path: str, out_root: str) -> DataFrame:
    """Evaluate a saved model on the saved test split: load, feature check (E11), score, E1-E10, reports.

    Writes the scored rows, the metric bundle, the per-class report and the
    threshold sweep under ``out_root``; returns the bundle's (metric, value) rows.
    """
    import os

    from vitalframe.operators import metrics as ev
    from vitalframe.operators import models as ml
    from vitalframe.sources import io as sio

    model = ml.ModelBundle.load(model_path)
    test = sio.read_split(spark, splits_path, "test")
    # written once: every report reads the scores, none scores again
    model.score(test, keep=("id",)).write.mode("overwrite").parquet(os.path.join(out_root, "scored"))
    scored = spark.read.parquet(os.path.join(out_root, "scored"))
    for name, report in (("metrics", ev.evaluation_bundle(scored)), ("class_report", ev.classification_report(scored)),
                         ("threshold_sweep", ev.threshold_sweep(scored)), ("calibration", ev.calibration_bins(scored))):
        report.write.mode("overwrite").json(os.path.join(out_root, name))
    return spark.read.schema("metric string, value double").json(os.path.join(out_root, "metrics"))


def retrain(spark: SparkSession, table: DataFrame, out_root: str, names: list[str] | None = None,
            baseline_params: dict[str, dict] | None = None, grid: dict[str, list] | None = None,
            baseline_folds: int = 5, grid_folds: int = 3, fit_rows: int | None = None, parallelism: int | None = None) -> dict:
    """The retrain path as one plan: 80/20 split, baseline CV of the models, grid
    search of the boosting model, refitted winner, test metrics, improvement on
    the previous model, saved model and parameter record with its CV score.

    The baseline has ``models.RETRAIN_BASELINE`` unless told otherwise. The baseline
    and the grid search take all training rows, or a sample of about ``fit_rows``; the
    winner is fitted on all of them. The searches' ledgers
    stay under ``out_root``, so a plan that is run again there fits only what is missing.
    """
    import os

    from vitalframe.operators import metrics as ev
    from vitalframe.operators import models as ml
    from vitalframe.operators import search
    from vitalframe.operators.split import train_test_split
    from vitalframe.operators.tree_score import BoostedBundle
    from vitalframe.sources import io as sio

    p = {k: os.path.join(out_root, k) for k in ("splits", "baseline", "baseline_ledger", "grid", "grid_ledger", "test_metrics", "runs", "improvement", "best_params", "model")}
    train_test_split(table).write.mode("overwrite").partitionBy("split").parquet(p["splits"])
    splits_df = spark.read.parquet(p["splits"])
    train, test = (splits_df.where(splits_df["split"] == s).drop("split") for s in ("train", "test"))
    baseline = search.cross_validate(train, names, baseline_folds, baseline_params or ml.RETRAIN_BASELINE, fit_rows=fit_rows, ledger=p["baseline_ledger"], parallelism=parallelism)
    ml.cv_summary(baseline).write.mode("overwrite").json(p["baseline"])
    best, cv_score, points = search.grid_search(train, grid, grid_folds, fit_rows=fit_rows, ledger=p["grid_ledger"], parallelism=parallelism)
    points.write.mode("overwrite").json(p["grid"])
    bundle = BoostedBundle("XGBoost", search.refit(train, best), best)
    metrics = ev.basic_metrics(bundle.score(test, keep=("id",)))
    m = metrics.first().asDict()
    metrics.write.mode("overwrite").json(p["test_metrics"])
    runs = ml.runs_rows(spark, os.path.basename(out_root), bundle.name, best, m, "retrain")
    ml.log_runs(runs, p["runs"])
    ml.improvement(runs).write.mode("overwrite").json(p["improvement"])
    sio.write_json_record(ml.best_params_record(spark, bundle.name, best, cv_score, m), p["best_params"])
    bundle.save(p["model"])
    return {"paths": p, "best_params": best, "cv_score": cv_score, "test_metrics": m}
