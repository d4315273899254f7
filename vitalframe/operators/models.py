"""Model fit, cross-validation, tuning and selection (M1-M18) with Spark ML.

Every fit is a distributed Spark ML job; the driver only loops over the
four registry entries, folds or parameter maps (a handful of iterations)
and keeps fitted model objects. Scores always go back through the exact
DataFrame metrics of ``metrics.py``, grouped by (model, fold / split), so a
whole CV round is evaluated in one aggregation.

Scaling uses the population standard deviation (``split.fit_standard_scaler``)
fitted on the training rows only, and is applied inside every CV fold from
that fold's own training rows (no leakage from the held-out fold).
"""

from __future__ import annotations

import itertools
import json
import math
import os
import random
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.errors import IllegalArgumentException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalframe.operators import metrics as ev
from vitalframe.operators.split import ScalerModel, fit_standard_scaler, hash_unit, kfold
from vitalframe.schema import CLASSIFICATION_THRESHOLD, MODEL_FEATURES, RANDOM_STATE

# --------------------------------------------------------------------------
# Model names and configured hyper-parameters of the reference
# --------------------------------------------------------------------------

MODEL_CONFIG: dict[str, dict] = {
    "Logistic_Regression": {"C": 1.0, "max_iter": 1000},
    "Random_Forest": {"n_estimators": 100, "max_depth": 15, "min_samples_split": 10,
                      "min_samples_leaf": 4},
    "Gradient_Boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5,
                          "min_samples_split": 10, "min_samples_leaf": 4},
    "XGBoost": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 5,
                "min_child_weight": 3, "subsample": 0.8, "colsample_bytree": 0.8},
}

# Settings of the retrain path's baseline (its library's defaults filled in).
RETRAIN_BASELINE: dict[str, dict] = {
    "Logistic_Regression": {"C": 1.0, "max_iter": 1000},
    "Random_Forest": {"n_estimators": 100, "max_depth": 15, "min_samples_split": 2, "min_samples_leaf": 1},
    "Gradient_Boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5, "min_samples_split": 2, "min_samples_leaf": 1},
    "XGBoost": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 5, "min_child_weight": 1, "subsample": 1.0, "colsample_bytree": 1.0},
}

# Grid of the retrain script: 3 * 3 * 3 * 3 * 2 = 162 combinations, 3-fold.
RETRAIN_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [3, 5, 7],
    "learning_rate": [0.01, 0.05, 0.1],
    "min_child_weight": [1, 3, 5],
    "subsample": [0.8, 1.0],
}

# Random-search spaces: (kind, low, high) or ("cat", [values]).
SEARCH_SPACES = {
    "Logistic_Regression": {"C": ("logfloat", 0.01, 10.0), "solver": ("cat", ["lbfgs", "liblinear"])},
    "Random_Forest": {"n_estimators": ("int", 50, 300), "max_depth": ("int", 5, 30),
                      "min_samples_split": ("int", 2, 20), "min_samples_leaf": ("int", 1, 10)},
    "Gradient_Boosting": {"n_estimators": ("int", 50, 300), "learning_rate": ("logfloat", 0.01, 0.3),
                          "max_depth": ("int", 3, 10), "min_samples_split": ("int", 2, 20),
                          "min_samples_leaf": ("int", 1, 10)},
    "XGBoost": {"n_estimators": ("int", 50, 300), "learning_rate": ("logfloat", 0.01, 0.3),
                "max_depth": ("int", 3, 10), "min_child_weight": ("int", 1, 10),
                "subsample": ("float", 0.6, 1.0), "colsample_bytree": ("float", 0.6, 1.0)},
}

PREVIOUS_MODEL_AUC = 0.7997

# Ids (rows times trees) of a forest's nodes that are cached at most; beyond, every
# pass walks the trees from their roots. The fitted forest is the same.
NODE_IDS = 400_000_000

# Spark's tree depth limit.
MAX_TREE_DEPTH = 30


# ------------------------------------------------------------------ M1 - M5

def build_estimator(name: str, params: dict | None = None, n_train: int | None = None,
                    seed: int = RANDOM_STATE):
    """M1: estimator for a registry name with reference-style parameters.

    * Logistic_Regression: L2 with sklearn's C mapped to regParam = 1 / (C * n),
      tol 1e-4 (the lbfgs default of the reference's library).
    * Random_Forest: numTrees, maxDepth, minInstancesPerNode (see below).
    * Gradient_Boosting / XGBoost: GBTClassifier (log-loss boosting); XGBoost's
      subsample / colsample_bytree map to subsamplingRate / featureSubsetStrategy.

    Spark bounds the rows of a child, so all three size limits map to
    minInstancesPerNode, here and in every search: min_samples_leaf and
    min_child_weight (a hessian sum, nearest in rows) as they are,
    min_samples_split as half of it, the largest of those given. A depth that
    Spark does not support and unknown parameters raise; ``solver`` names an
    optimiser of the same optimum and is listed by ``without_effect``.
    """
    if name not in MODEL_CONFIG:
        raise ValueError(f"no such model: {name} (known: {', '.join(MODEL_CONFIG)})")
    unknown = set(params or {}) - set(MODEL_CONFIG[name]) - set(SEARCH_SPACES[name]) - {"tol"}
    if unknown:
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    p = dict(MODEL_CONFIG[name])
    p.update(params or {})
    common = dict(featuresCol="features", labelCol="label")
    if name == "Logistic_Regression":
        n = max(int(n_train or 1), 1)
        return LogisticRegression(regParam=1.0 / (float(p["C"]) * n), elasticNetParam=0.0,
                                  maxIter=int(p["max_iter"]), tol=float(p.get("tol", 1e-4)),
                                  standardization=False, **common)
    depth = int(p["max_depth"])
    if depth > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {depth}: Spark trees reach {MAX_TREE_DEPTH} levels")
    per_node = max(int(p.get("min_samples_leaf", 1)), int(p.get("min_child_weight", 1)), -(-int(p.get("min_samples_split", 2)) // 2))
    if name == "Random_Forest":
        return RandomForestClassifier(numTrees=int(p["n_estimators"]), maxDepth=depth,
                                      minInstancesPerNode=per_node,
                                      cacheNodeIds=bool(n_train) and n_train * int(p["n_estimators"]) <= NODE_IDS,
                                      seed=seed, **common)
    if name == "Gradient_Boosting":
        return GBTClassifier(maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]),
                             maxDepth=depth, minInstancesPerNode=per_node,
                             seed=seed, **common)
    return GBTClassifier(maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]),
                         maxDepth=depth, minInstancesPerNode=per_node, subsamplingRate=float(p.get("subsample", 1.0)),
                         featureSubsetStrategy=str(float(p.get("colsample_bytree", 1.0)))
                         if float(p.get("colsample_bytree", 1.0)) < 1.0 else "all",
                         seed=seed, **common)


def without_effect(params: dict) -> list[str]:
    """Parameters of a draw that do not change the fitted model."""
    return sorted(set(params) & {"solver"})


# ------------------------------------------------------------------ data prep

#: Partitions of a fit's input. Forests and boosting draw their samples per
#: partition, so the count is a setting of the fit (raise it for large tables),
#: not something that follows the cluster.
FIT_PARTITIONS = 16


def fit_input(df: DataFrame, features: list[str], label: str = "cardio", partitions: int = FIT_PARTITIONS) -> DataFrame:
    """Feature and label columns, dealt out and ordered by their values: the same on any cluster."""
    cols = [*features, label]
    return df.select(*cols).repartition(partitions, *cols).sortWithinPartitions(*cols)


def fit_rows_sample(df: DataFrame, fit_rows: int | None, n_rows: int, id_col: str = "id", seed: int = RANDOM_STATE) -> DataFrame:
    """At most about ``fit_rows`` labelled rows by id hash (the same share of every label); all without a bound."""
    if fit_rows is None or n_rows <= fit_rows:
        return df
    return df.where(hash_unit(id_col, seed + 1) < F.lit(fit_rows / n_rows))


def assemble(df: DataFrame, features: list[str], label: str = "cardio",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Scaled feature columns -> one vector column; label as double."""
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    cols = [c for c in keep if c in df.columns]
    return va.transform(df).select(*cols, "features",
                                   F.col(label).cast("double").alias("label"))


@dataclass
class ModelBundle:
    """A fitted model with its scaler and feature list (what scoring needs)."""
    name: str
    features: list[str]
    scaler: ScalerModel
    model: object
    params: dict = field(default_factory=dict)

    def score(self, df: DataFrame, keep: tuple[str, ...] = ("id",),
              threshold: float = CLASSIFICATION_THRESHOLD) -> DataFrame:
        """(keep..., label?, probability, prediction) for rows with the feature columns (E11 is checked)."""
        ev.require_features(df.columns, self.features)
        scaled = self.scaler.transform(df, self.features)
        va = VectorAssembler(inputCols=self.features, outputCol="features")
        cols = [c for c in keep if c in df.columns]
        lab = [F.col("cardio").cast("int").alias("label")] if "cardio" in df.columns else []
        out = self.model.transform(va.transform(scaled).select(*cols, *lab, "features"))
        p = vector_to_array(F.col("probability")).getItem(1)
        return out.select(*cols, *[c for c in ("label",) if lab], p.alias("probability")) \
            .withColumn("prediction", (F.col("probability") > threshold).cast("int"))

    def save(self, path: str) -> None:
        """Spark ML model directory + scaler / metadata JSON written through Spark."""
        self.model.write().overwrite().save(os.path.join(path, "model"))
        spark = SparkSession.getActiveSession()
        meta = {"name": self.name, "features": self.features, "params": self.params,
                "scaler": self.scaler.to_dict(), "model_class": type(self.model).__name__}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(os.path.join(path, "meta"))

    @staticmethod
    def load(path: str) -> "ModelBundle":
        from pyspark.ml.classification import (
            GBTClassificationModel,
            LogisticRegressionModel,
            RandomForestClassificationModel,
        )
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
        if meta["model_class"] == "BoostedModel":
            from vitalframe.operators.tree_score import BoostedBundle
            return BoostedBundle.of(meta)
        cls = {"LogisticRegressionModel": LogisticRegressionModel,
               "RandomForestClassificationModel": RandomForestClassificationModel,
               "GBTClassificationModel": GBTClassificationModel}[meta["model_class"]]
        return ModelBundle(meta["name"], meta["features"], ScalerModel.from_dict(meta["scaler"]),
                           cls.load(os.path.join(path, "model")), meta.get("params", {}))


def shared_input(train: DataFrame, features: list[str], partitions: int = FIT_PARTITIONS) -> tuple[DataFrame, ScalerModel]:
    """M6: a fit's cached input and the scaler of its rows; several fits may share them.

    Only the feature and label columns are cached (spillable), so the
    upstream plan runs once for the scaler statistics, the row count and
    every optimiser iteration.
    """
    from vitalframe.session import checkpoint_root
    checkpoint_root(train.sparkSession)  # boosting cuts its lineage there
    base = fit_input(train, features, partitions=partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return base, fit_standard_scaler(base, features)  # also counts the rows (regParam needs n)
    except BaseException:
        base.unpersist()
        raise


def fit_shared(name: str, base: DataFrame, scaler: ScalerModel, features: list[str], params: dict | None = None) -> ModelBundle:
    """M6 (fit part): the estimator on a ``shared_input``."""
    data = assemble(scaler.transform(base, features), features)
    model = build_estimator(name, params, n_train=scaler.n_rows).fit(data)
    return ModelBundle(name, features, scaler, model, dict(params or {}))


def fit_features(train: DataFrame, features: list[str] | None = None) -> list[str]:
    """The features of a fit; by default the model's that are columns of the training rows."""
    feats = features or [c for c in MODEL_FEATURES if c in train.columns]
    if not feats:
        raise ValueError("none of the model's features is a column of the training rows")
    return feats


def fit_columns(splits: DataFrame, features: list[str] | None = None) -> DataFrame:
    """What fits, scores and their metrics read of a split table: key, split, label and features."""
    wanted = dict.fromkeys(["id", "split", "cardio", *fit_features(splits, features)])
    return splits.select(*[c for c in wanted if c in splits.columns or c in (features or [])])


def fit_bundle(name: str, train: DataFrame, features: list[str] | None = None,
               params: dict | None = None, partitions: int = FIT_PARTITIONS) -> ModelBundle:
    """M6 (fit part): scaler on the training rows, then the estimator."""
    feats = fit_features(train, features)
    base, scaler = shared_input(train, feats, partitions)
    try:
        return fit_shared(name, base, scaler, feats, params)
    finally:
        base.unpersist()


# ------------------------------------------------------------------ M6 / M7 / M10 / M11

def train_and_evaluate(splits: DataFrame, names: list[str] | None = None,
                       params: dict[str, dict] | None = None,
                       features: list[str] | None = None) -> tuple[dict[str, ModelBundle], DataFrame]:
    """M6 + M7: fit each registry model on split='train'; score train and
    validation; return fitted bundles and per-(model, split) metrics."""
    names = names or list(MODEL_CONFIG)
    # The split table feeds every fit and every scoring pass: write it once to
    # the shared checkpoint folder (cuts the lineage; lost executors re-read it).
    feats = fit_features(splits, features)
    cached = reliable_checkpoint(fit_columns(splits, feats))
    # all models are fitted on the same rows: they are dealt out, sorted and cached once
    base, scaler = shared_input(cached.where(F.col("split") == "train"), feats)
    bundles, scored = {}, None
    try:
        for order, name in enumerate(names):
            b = fit_shared(name, base, scaler, feats, (params or {}).get(name))
            bundles[name] = b
            s = b.score(cached.where(F.col("split").isin("train", "validation")), keep=("id", "split")) \
                .withColumn("model", F.lit(name)).withColumn("model_order", F.lit(order))
            scored = s if scored is None else scored.unionByName(s)
    finally:
        base.unpersist()
    # a few rows per (model, split), written once
    return bundles, reliable_checkpoint(ev.basic_metrics(scored, ["model", "model_order", "split"]))


def training_summary(metrics: DataFrame) -> DataFrame:
    """M10 + M11: validation metrics per model, ``is_best`` on the highest
    validation AUC (null counts as 0, the first registered model wins ties),
    sorted by AUC descending."""
    val = metrics.where(F.col("split") == "validation")
    auc0 = F.coalesce(F.col("roc_auc"), F.lit(0.0))
    best = val.orderBy(auc0.desc(), F.col("model_order").asc()).limit(1) \
        .select(F.col("model").alias("_best"))
    out = val.join(best, F.col("model") == F.col("_best"), "left")
    return out.select("model", "accuracy", "precision", "recall", "f1_score", "roc_auc",
                      F.col("_best").isNotNull().alias("is_best"), "model_order") \
        .orderBy(auc0.desc(), "model_order")


def select_best(summary: DataFrame) -> str:
    """Name of the best model (one row collected)."""
    row = summary.where("is_best").select("model").first()
    if row is None:
        raise ValueError("the summary names no best model")
    return row[0]


# ------------------------------------------------------------------ M8 / M9 / M16

def cross_validate(df: DataFrame, names: list[str] | None = None, k: int = 5,
                   params: dict[str, dict] | None = None, features: list[str] | None = None,
                   exact_folds: bool = True, seed: int = RANDOM_STATE) -> DataFrame:
    """M8 + M9: stratified k-fold CV; returns per-(model, fold) accuracy, f1
    and exact ROC-AUC as a long fold-score table (model, fold, metric, value).

    Each fold's scaler is fitted on that fold's training rows. The k * models
    fits run one after another (each distributed); all held-out scores are
    unioned and evaluated in one grouped aggregation.
    """
    names = names or list(MODEL_CONFIG)
    # A caller that already has a checkpointed ``fold`` column (e.g. a tuning
    # loop) passes it in; otherwise the folds are built and written once here.
    folded = df if "fold" in df.columns else reliable_checkpoint(
        kfold(df, k=k, exact=exact_folds, seed=seed))
    scored = None
    try:
        for name in names:
            for f in range(k):
                b = fit_bundle(name, folded.where(F.col("fold") != f), features,
                               (params or {}).get(name))
                s = b.score(folded.where(F.col("fold") == f), keep=("id",)) \
                    .withColumn("model", F.lit(name)).withColumn("fold", F.lit(f))
                scored = s if scored is None else scored.unionByName(s)
        m = ev.basic_metrics(scored, ["model", "fold"], constant_score_auc=None)
        arr = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"))
                        for n in ("accuracy", "f1_score", "roc_auc")])
        long = m.select("model", "fold", F.explode(arr).alias("m")).select("model", "fold", "m.*")
        return long.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        if folded is not df:
            folded.unpersist(blocking=False)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the session's checkpoint folder and cut its lineage."""
    from vitalframe.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def cv_summary(fold_scores: DataFrame) -> DataFrame:
    """M8 / M9 summary: mean, population std, score list and the 95% text per (model, metric);
    ``is_best`` marks each metric's best model by mean (a few rows)."""
    g = fold_scores.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.array_sort(F.collect_list(F.struct("fold", "value"))).alias("_s"))
    return g.select(
        "model", "metric", F.col("mean").alias("mean"), F.col("std").alias("std"),
        F.transform("_s", lambda x: x["value"]).alias("scores"),
        F.format_string("%.4f +/- %.4f", F.col("mean"), F.col("std") * 1.96).alias("ci_95"),
        (F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("mean"), "model")) == 1).alias("is_best"))


# ------------------------------------------------------------------ M12 - M15

def grid_points(grid: dict[str, list]) -> list[dict]:
    """Every combination of a grid, in order."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def grid_search(train: DataFrame, grid: dict[str, list] | None = None, folds: int = 3,
                features: list[str] | None = None, parallelism: int = 4,
                seed: int = RANDOM_STATE, fit_rows: int | None = None, name: str = "XGBoost",
                partitions: int = FIT_PARTITIONS):
    """Grid search, stratified ``folds``-fold, exact ROC-AUC, winner refitted.

    Returns (best params, best CV score, table of (params, cv_auc, fit_rows),
    bundle of the winner fitted on all training rows). Every fold's scaler is
    fitted on that fold's own training rows; each assembled fold is written once
    and shared by all grid points. ``fit_rows`` bounds the labelled rows of the
    search (not of the refit); None takes all. ``parallelism`` fits run at once.
    """
    feats = features or [c for c in MODEL_FEATURES if c in train.columns]
    rows_of = fit_rows_sample(train, fit_rows, train.count() if fit_rows else 0, seed=seed)
    folded = reliable_checkpoint(kfold(rows_of, k=folds, exact=True, seed=seed))
    parts = []
    for f in range(folds):
        scaler = fit_standard_scaler(folded.where(F.col("fold") != f), feats)
        part = [assemble(scaler.transform(fit_input(folded.where(keep), feats, partitions=partitions), feats), feats)
                for keep in (F.col("fold") != f, F.col("fold") == f)]
        parts.append((scaler.n_rows, *[p.persist(StorageLevel.MEMORY_AND_DISK) for p in part]))
    points = grid_points(grid or RETRAIN_GRID)
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)

    def score(job: tuple[int, int]) -> float:
        n, fit_part, held_out = parts[job[1]]
        return auc.evaluate(build_estimator(name, points[job[0]], n, seed).fit(fit_part).transform(held_out))

    try:
        jobs = [(i, f) for i in range(len(points)) for f in range(folds)]
        with ThreadPool(parallelism) as pool:
            scores = dict(zip(jobs, pool.map(score, jobs, chunksize=1)))
    finally:
        for _, a, b in parts:
            a.unpersist()
            b.unpersist()
    means = [sum(scores[i, f] for f in range(folds)) / folds for i in range(len(points))]
    best = max(range(len(points)), key=means.__getitem__)
    table = train.sparkSession.createDataFrame(
        [(json.dumps(p, sort_keys=True), m, fit_rows) for p, m in zip(points, means)], "params string, cv_auc double, fit_rows int")
    return points[best], means[best], table, fit_bundle(name, train, feats, points[best], partitions)


def sample_params(name: str, n_trials: int, seed: int = RANDOM_STATE) -> list[dict]:
    """Seeded random draws from the model's search space."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_trials):
        d = {}
        for k, spec in SEARCH_SPACES[name].items():
            kind = spec[0]
            if kind == "cat":
                d[k] = rng.choice(spec[1])
            elif kind == "int":
                d[k] = rng.randint(spec[1], spec[2])
            elif kind == "float":
                d[k] = rng.uniform(spec[1], spec[2])
            else:
                d[k] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
        out.append(d)
    return out


#: Errors of a fit itself; anything else (a lost executor, a wrong column) is raised.
FIT_ERRORS = (ValueError, IllegalArgumentException)


def tune(df: DataFrame, name: str, n_trials: int = 50, k: int = 3,
         features: list[str] | None = None, seed: int = RANDOM_STATE,
         direction: str = "maximize", fit_rows: int | None = None) -> DataFrame:
    """Random search; each trial is a k-fold CV (mean ROC-AUC).

    Returns (model, trial, params, score, error, without_effect, fit_rows), best
    first. A draw that the model cannot be fitted with keeps its error, scores
    0.0 and ranks last in either direction. ``fit_rows`` bounds the labelled
    rows; None takes all.
    """
    trials = sample_params(name, n_trials, seed)
    rows_of = fit_rows_sample(df, fit_rows, df.count() if fit_rows else 0, seed=seed)
    folded = reliable_checkpoint(kfold(rows_of, k=k, exact=True, seed=seed))  # shared by all trials
    rows = []
    for i, p in enumerate(trials):
        score, error = 0.0, None
        try:
            fs = cross_validate(folded, [name], k=k, params={name: p}, features=features, seed=seed)
            got = fs.where("metric = 'roc_auc'").agg(F.avg("value")).first()[0]
            fs.unpersist()
            score = float(got) if got is not None else 0.0
        except FIT_ERRORS as e:
            error = str(e)
        rows.append((name, i, json.dumps(p, sort_keys=True), score, error, without_effect(p), fit_rows))
    out = df.sparkSession.createDataFrame(rows, "model string, trial int, params string, score double, error string, without_effect array<string>, fit_rows int")
    return out.orderBy(F.col("error").isNotNull(), F.desc("score") if direction == "maximize" else F.asc("score"), "trial")


def tune_all(df: DataFrame, names: list[str] | None = None, **settings) -> DataFrame:
    """M14 over several models: all trials, ``is_best`` on the best of all, best first."""
    names = names or list(MODEL_CONFIG)
    trials = [tune(df, n, **settings) for n in names]
    out = trials[0]
    for t in trials[1:]:
        out = out.unionByName(t)
    order = F.desc("score") if settings.get("direction", "maximize") == "maximize" else F.asc("score")
    # n_trials rows a model
    rank = F.row_number().over(Window.orderBy(F.col("error").isNotNull(), order, "model", "trial"))
    return out.withColumn("is_best", (rank == 1) & F.col("error").isNull()).orderBy(F.desc("is_best"), F.col("error").isNotNull(), order, "model", "trial")


def tuned_estimator(name: str, best_params: dict, n_train: int | None = None):
    """Estimator from the best parameters plus the fixed ones."""
    return build_estimator(name, best_params, n_train)


# ------------------------------------------------------------------ M17 / M18 / S8 / S9

def feature_importance(bundle: ModelBundle) -> DataFrame | None:
    """(feature, importance) sorted descending; None for models without it."""
    if not hasattr(bundle.model, "featureImportances"):
        return None
    imp = bundle.model.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(list(zip(bundle.features, [float(x) for x in imp])),
                                 "feature string, importance double").orderBy(F.desc("importance"))


def improvement(runs: DataFrame, previous_auc: float = PREVIOUS_MODEL_AUC,
                previous_runs: DataFrame | None = None) -> DataFrame:
    """(auc - previous) / previous * 100 for each run's test AUC.

    The previous AUC is the stored constant, or, with ``previous_runs``, the
    best earlier test AUC of the same model (an equi-join on the model name;
    the previous side has one row per model).
    """
    cur = runs.where(F.col("metric") == "roc_auc").select(
        "run_id", "model", F.col("value").alias("roc_auc"))
    if previous_runs is None:
        prev = F.lit(float(previous_auc))
        out = cur.withColumn("previous_auc", prev)
    else:
        best_prev = previous_runs.where(F.col("metric") == "roc_auc").groupBy("model").agg(
            F.max("value").alias("previous_auc"))
        out = cur.join(best_prev, "model", "left")
    return out.select(
        "run_id", "model", "roc_auc", "previous_auc",
        ((F.col("roc_auc") - F.col("previous_auc")) / F.col("previous_auc") * 100)
        .alias("improvement_pct"))


def previous_runs_as_of(runs: DataFrame, model: str = "model", run_id: str = "run_id", value: str = "value", at: str = "logged_at") -> DataFrame:
    """M17 as of each run's time: the last strictly earlier run of the same model, and the improvement on it.

    (run_id, model, logged_at, value, previous_run, previous_value, improvement_pct).
    Runs of one instant do not see each other; of several earlier runs of one
    instant the greatest run_id counts. A late run takes its place by its own time.
    Runs without a time or value are no one's previous run and have none. Windows
    hold one model and day; the days' last runs are carried over by a window of days.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = runs.select(F.col(run_id).alias("run_id"), F.col(model).alias("model"), F.col(at).alias("logged_at"), F.col(value).cast("double").alias("value"), micros.alias("us"))
    rows = rows.withColumns({"day": F.floor(F.col("us") / F.lit(86_400_000_000.0)), "run": F.when(F.col("us").isNotNull() & F.col("value").isNotNull(), F.struct("us", "run_id", "value"))})
    days = rows.groupBy("model", "day").agg(F.max("run").alias("last"))
    before = Window.partitionBy("model").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(F.col("model").alias("m"), F.col("day").alias("d"), F.max("last").over(before).alias("carried"))
    within = Window.partitionBy("model", "day").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("same_day", F.max("run").over(within)).join(carried, F.col("model").eqNullSafe(F.col("m")) & F.col("day").eqNullSafe(F.col("d")))
    previous = F.when(F.col("us").isNotNull(), F.coalesce("same_day", "carried"))
    out = found.select("run_id", "model", "logged_at", "value", previous.alias("p"))
    return out.select("run_id", "model", "logged_at", "value", F.col("p.run_id").alias("previous_run"), F.col("p.value").alias("previous_value"),
                      F.try_divide((F.col("value") - F.col("p.value")) * 100, F.col("p.value")).alias("improvement_pct"))


def runs_rows(spark: SparkSession, run_id: str, model: str, params: dict,
              metrics: dict[str, float], stage: str) -> DataFrame:
    """S9 rows: one per metric, with the parameters as JSON."""
    rows = [(run_id, model, stage, json.dumps(params, sort_keys=True), k, float(v))
            for k, v in metrics.items()]
    return spark.createDataFrame(
        rows, "run_id string, model string, stage string, params string, metric string, value double"
    ).withColumn("logged_at", F.current_timestamp())


def importance_rows(run_id: str, bundle: "ModelBundle", stage: str = "train") -> DataFrame | None:
    """Feature importances as runs-table rows (metric = 'importance:<feature>')."""
    imp = feature_importance(bundle)
    if imp is None:
        return None
    return imp.select(
        F.lit(run_id).alias("run_id"), F.lit(bundle.name).alias("model"), F.lit(stage).alias("stage"),
        F.lit(json.dumps(bundle.params, sort_keys=True)).alias("params"),
        F.concat(F.lit("importance:"), F.col("feature")).alias("metric"),
        F.col("importance").alias("value"),
    ).withColumn("logged_at", F.current_timestamp())


def log_runs(rows: DataFrame, path: str) -> None:
    """Write the rows of each run to the runs table (parquet, one folder a run and stage).

    A stage that runs again replaces its own rows instead of doubling them.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "stage").parquet(path)


def best_params_record(spark: SparkSession, model_name: str, params: dict, cv_score: float | None,
                       test_metrics: dict[str, float]) -> DataFrame:
    """One-row (model_name, params, cv_score, test_metrics) record."""
    return spark.createDataFrame(
        [(model_name, json.dumps(params, sort_keys=True),
          None if cv_score is None or (isinstance(cv_score, float) and math.isnan(cv_score)) else float(cv_score),
          {k: float(v) for k, v in test_metrics.items()})],
        "model_name string, params string, cv_score double, test_metrics map<string,double>")
