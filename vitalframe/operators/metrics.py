"""Evaluation operators (E1-E13) over a score table.

A score table has ``label`` (0/1), ``probability`` (of class 1) and
``prediction`` (0/1), plus optional group columns (split, model, fold).
Every metric is a conditional aggregate in one pass, grouped by the group
columns; the threshold sweep evaluates all thresholds in that same pass
(no join, no row multiplication). ROC-AUC is exact (ties count one half)
and uses distributed prefix sums over distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.operators.ordered import exclusive_prefix_sums

THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]
CALIBRATION_BINS = 10


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))


def confusion_counts(scored: DataFrame, group_cols: list[str] | None = None,
                     label: str = "label", pred: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp (and n) per group in one aggregate."""
    g = group_cols or []
    y, p = F.col(label), F.col(pred)
    return scored.groupBy(*g).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count(F.lit(1)).alias("n"),
    )


def _metric_cols(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    n = tn + fp + fn + tp
    return {
        "accuracy": _ratio(tp + tn, n),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def basic_metrics(scored: DataFrame, group_cols: list[str] | None = None,
                  with_auc: bool = True, constant_score_auc: float | None = 0.0) -> DataFrame:
    """E1 + E2 + E4: accuracy, precision, recall, f1, roc_auc, specificity per group.

    With the AUC, everything comes from one checkpointed per-score summary,
    so the scored rows (and their upstream plan) are computed once.
    """
    g = group_cols or []
    if with_auc:
        summary = materialize(score_summary(scored, g))
        cc = counts_from_summary(summary, g)
    else:
        cc = confusion_counts(scored, g)
    m = _metric_cols(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))
    out = cc.select(*g, *[v.alias(k) for k, v in m.items()],
                    (_ratio(F.col("tn"), F.col("tn") + F.col("fp"))).alias("specificity"))
    if with_auc:
        auc = auc_from_summary(summary, g, constant_score_auc=constant_score_auc)
        out = merge_rows([out, auc], g)
    return out


def score_summary(scored: DataFrame, group_cols: list[str] | None = None, label: str = "label",
                  score: str = "probability", pred: str = "prediction") -> DataFrame:
    """(groups, score, pos, neg, tp, fp): one row per distinct score per group.

    A map-side partially aggregated group-by: a score shared by a third of all
    rows is one row. Every metric below is a function of the score, so this
    reduced table is all the evaluation needs.
    """
    g = group_cols or []
    y = F.col(label)
    has_pred = pred in scored.columns
    pr = F.col(pred) if has_pred else F.lit(None)
    return scored.groupBy(*g, F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"),
        F.count_if((y == 1) & (pr == 1)).alias("tp"), F.count_if((y == 0) & (pr == 1)).alias("fp"))


def materialize(df: DataFrame) -> DataFrame:
    """Write a reduced table once to the checkpoint folder (lineage cut)."""
    from vitalframe.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def counts_from_summary(summary: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp, n per group from the per-score summary."""
    g = group_cols or []
    a = summary.groupBy(*g).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
                                F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    return a.select(*g, (F.col("_n") - F.col("fp")).alias("tn"), "fp",
                    (F.col("_p") - F.col("tp")).alias("fn"), "tp",
                    (F.col("_p") + F.col("_n")).alias("n"))


def merge_rows(frames: list[DataFrame], group_cols: list[str]) -> DataFrame:
    """Combine per-group result rows that carry different columns, without a join.

    The frames are unioned (missing columns become null) and each column's
    single non-null value is taken per group. With no groups this merges
    one-row results; there is no cross join and no constant-key join.
    """
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    cols = []
    for f in frames:
        cols += [c for c in f.columns if c not in group_cols and c not in cols]
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in cols]
    return (u.groupBy(*group_cols).agg(*aggs) if group_cols else u.agg(*aggs))


def roc_auc(scored: DataFrame, group_cols: list[str] | None = None, label: str = "label",
            score: str = "probability", constant_score_auc: float | None = 0.0,
            num_buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC per group (Mann-Whitney; ties count one half).

    Scores are first reduced to (score, positives, negatives) per group, so
    a score shared by a third of all rows is one row. The count of negatives
    below each score comes from distributed prefix sums. One class missing
    -> null; a single distinct score -> ``constant_score_auc`` (0.0 as in
    the training summary; pass 0.5 for the plain statistic).
    """
    g = group_cols or []
    summary = materialize(score_summary(scored, g, label, score))
    return auc_from_summary(summary, g, constant_score_auc, num_buckets)


def auc_from_summary(summary: DataFrame, group_cols: list[str] | None = None,
                     constant_score_auc: float | None = 0.0,
                     num_buckets: int | None = None) -> DataFrame:
    """E2 from a (materialised) per-score summary."""
    g = group_cols or []
    per = summary.select(*g, "score", "pos", "neg")
    pre = exclusive_prefix_sums(per, g, ["score"], ["neg"], num_buckets)
    agg = pre.groupBy(*g).agg(
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        F.count(F.lit(1)).alias("_distinct"))
    auc = F.col("_u") / (F.col("_p") * F.col("_n"))
    if constant_score_auc is not None:
        auc = F.when(F.col("_distinct") <= 1, F.lit(float(constant_score_auc))).otherwise(auc)
    auc = F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(None).cast("double")).otherwise(auc)
    return agg.select(*g, auc.alias("roc_auc"))


def confusion_matrix(scored: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """2x2 matrix, one row per actual class: (actual, predicted_0, predicted_1)."""
    g = group_cols or []
    cc = confusion_counts(scored, g)
    rows = F.array(
        F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"),
                 F.col("fp").alias("predicted_1")),
        F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"),
                 F.col("tp").alias("predicted_1")))
    return cc.select(*g, F.explode(rows).alias("r")).select(*g, "r.*")


def specificity(scored: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """TN / (TN + FP)."""
    g = group_cols or []
    cc = confusion_counts(scored, g)
    return cc.select(*g, (_ratio(F.col("tn"), F.col("tn") + F.col("fp"))).alias("specificity"))


def classification_report(scored: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """E5: per class precision / recall / f1 / support, accuracy, macro and weighted avg.

    The accuracy row carries the accuracy in ``f1_score`` and the total in
    ``support`` (how the printed report lays it out).
    """
    g = group_cols or []
    cc = confusion_counts(scored, g)
    tn, fp, fn, tp, n = (F.col(c) for c in ("tn", "fp", "fn", "tp", "n"))
    p0, r0, f0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp)
    p1, r1, f1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)
    s0, s1 = tn + fp, tp + fn

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"),
                        r.alias("recall"), f.alias("f1_score"),
                        s.cast("bigint").alias("support"))

    nd = n.cast("double")
    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"),
            _ratio(tp + tn, n), n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", _ratio(p0 * s0 + p1 * s1, nd), _ratio(r0 * s0 + r1 * s1, nd),
            _ratio(f0 * s0 + f1 * s1, nd), n),
    )
    return cc.select(*g, F.explode(rows).alias("r")).select(*g, "r.*")


def calibration_bins(scored: DataFrame, group_cols: list[str] | None = None,
                     n_bins: int = CALIBRATION_BINS) -> DataFrame:
    """E6 detail: per non-empty bin: mean predicted, observed rate, count.

    Bins follow the uniform grid i * (1 / n_bins): a probability equal to an
    inner edge belongs to the lower bin, the first bin is closed.
    """
    g = group_cols or []
    step = 1.0 / n_bins
    edges = [i * step for i in range(1, n_bins)]
    p = F.col("probability")
    b = sum((p > F.lit(e)).cast("int") for e in edges)
    return scored.groupBy(*g, b.alias("bin")).agg(
        F.avg(p).alias("mean_predicted"),
        F.avg(F.col("label").cast("double")).alias("observed_rate"),
        F.count(F.lit(1)).alias("count"))


def calibration_error(scored: DataFrame, group_cols: list[str] | None = None,
                      n_bins: int = CALIBRATION_BINS) -> DataFrame:
    """Unweighted mean over non-empty bins of |observed - mean predicted|."""
    g = group_cols or []
    bins = calibration_bins(scored, g, n_bins)
    return bins.groupBy(*g).agg(
        F.avg(F.abs(F.col("observed_rate") - F.col("mean_predicted"))).alias("calibration_error"))


def reliability_metrics(scored: DataFrame, group_cols: list[str] | None = None,
                        summary: DataFrame | None = None) -> DataFrame:
    """Calibration error, high-confidence accuracy and share, mean / std of p.

    One aggregate of the rows into bins gives it all. With a per-score summary
    at hand, that is used instead: every quantity is a function of the score
    weighted by its row count.
    """
    g = group_cols or []
    if summary is None:
        return _reliability_by_bins(scored, g)
    sm = summary
    sc_, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    c = pos + neg
    high = (sc_ > 0.8) | (sc_ < 0.2)
    base = sm.groupBy(*g).agg(
        F.sum(F.when(high, c).otherwise(0)).alias("_high"),
        F.sum(F.when(high, F.when(sc_ > 0.5, pos).otherwise(neg)).otherwise(0)).alias("_hit"),
        F.sum(c).alias("_n"), F.sum(sc_ * c).alias("_s1"), F.sum(sc_ * sc_ * c).alias("_s2"))
    mean = F.col("_s1") / F.col("_n")
    var = F.greatest(F.col("_s2") / F.col("_n") - mean * mean, F.lit(0.0))
    rel = base.select(
        *g,
        _ratio(F.col("_hit"), F.col("_high")).alias("high_confidence_accuracy"),
        (_ratio(F.col("_high") * 100, F.col("_n"))).alias("high_confidence_percentage"),
        mean.alias("mean_predicted_probability"),
        F.sqrt(var).alias("std_predicted_probability"))
    step = 1.0 / CALIBRATION_BINS
    b = sum((sc_ > F.lit(i * step)).cast("int") for i in range(1, CALIBRATION_BINS))
    bins = sm.groupBy(*g, b.alias("bin")).agg(
        (F.sum(sc_ * c) / F.sum(c)).alias("mean_predicted"),
        (F.sum(pos) / F.sum(c)).alias("observed_rate"))
    ce = bins.groupBy(*g).agg(
        F.avg(F.abs(F.col("observed_rate") - F.col("mean_predicted"))).alias("calibration_error"))
    return merge_rows([rel, ce], g)


def _reliability_by_bins(scored: DataFrame, g: list[str]) -> DataFrame:
    """E6-E8 from one map-side aggregate per bin; the std adds variances within and between bins."""
    p, y = F.col("probability"), F.col("label")
    high = (p > 0.8) | (p < 0.2)
    b = sum((p > F.lit(i / CALIBRATION_BINS)).cast("int") for i in range(1, CALIBRATION_BINS))
    bins = scored.groupBy(*g, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(p).alias("_mean"), F.var_pop(p).alias("_var"),
        F.avg(y.cast("double")).alias("_rate"), F.count_if(high).alias("_high"),
        F.count_if(high & (y == (p > 0.5).cast("int"))).alias("_hit"))
    # CALIBRATION_BINS rows a group at most
    w = Window.partitionBy(*g)
    bins = bins.withColumn("_all", F.sum(F.col("_n") * F.col("_mean")).over(w) / F.sum("_n").over(w))
    away = F.col("_mean") - F.col("_all")
    return bins.groupBy(*g).agg(
        _ratio(F.sum("_hit"), F.sum("_high")).alias("high_confidence_accuracy"),
        _ratio(F.sum("_high") * 100, F.sum("_n")).alias("high_confidence_percentage"),
        F.max("_all").alias("mean_predicted_probability"),
        F.sqrt(F.sum(F.col("_n") * (F.col("_var") + away * away)) / F.sum("_n")).alias("std_predicted_probability"),
        F.avg(F.abs(F.col("_rate") - F.col("_mean"))).alias("calibration_error"))


def threshold_sweep(scored: DataFrame, group_cols: list[str] | None = None,
                    thresholds: list[float] | None = None) -> DataFrame:
    """Accuracy / precision / recall / f1 when class = (p >= t), for each t.

    All thresholds are counted in one aggregate over the score table, then
    the one-row-per-group result is unpivoted.
    """
    g = group_cols or []
    ts = thresholds or THRESHOLDS
    p, y = F.col("probability"), F.col("label")
    aggs = []
    for i, t in enumerate(ts):
        pr = p >= F.lit(t)
        aggs += [F.count_if(~pr & (y == 0)).alias(f"tn{i}"), F.count_if(pr & (y == 0)).alias(f"fp{i}"),
                 F.count_if(~pr & (y == 1)).alias(f"fn{i}"), F.count_if(pr & (y == 1)).alias(f"tp{i}")]
    wide = scored.groupBy(*g).agg(*aggs)
    structs = []
    for i, t in enumerate(ts):
        m = _metric_cols(F.col(f"tn{i}"), F.col(f"fp{i}"), F.col(f"fn{i}"), F.col(f"tp{i}"))
        structs.append(F.struct(F.lit(float(t)).alias("threshold"),
                                *[v.alias(k) for k, v in m.items()]))
    return wide.select(*g, F.explode(F.array(*structs)).alias("r")).select(*g, "r.*")


def evaluation_bundle(scored: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Every scalar metric as long-form (metric, value) rows per group."""
    g = group_cols or []
    summary = materialize(score_summary(scored, g))
    cc = counts_from_summary(summary, g)
    m = _metric_cols(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))
    basic = cc.select(*g, *[v.alias(k) for k, v in m.items()],
                      (_ratio(F.col("tn"), F.col("tn") + F.col("fp"))).alias("specificity"))
    auc = auc_from_summary(summary, g, constant_score_auc=None)
    rel = reliability_metrics(scored, g, summary=summary)
    both = merge_rows([basic, auc, rel], g)
    names = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "specificity",
             "calibration_error", "high_confidence_accuracy", "high_confidence_percentage",
             "mean_predicted_probability", "std_predicted_probability"]
    arr = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                    for n in names])
    return both.select(*g, F.explode(arr).alias("m")).select(*g, "m.*")


def feature_consistency(saved: list[str], present: list[str]) -> dict[str, list[str]]:
    """Compare saved feature names with the evaluation table's columns.

    Schema-only (no job): returns missing / extra names; raises on mismatch
    when used as a guard via ``check_feature_consistency``.
    """
    return {"missing": sorted(set(saved) - set(present)),
            "extra": sorted(set(present) - set(saved))}


def check_feature_consistency(saved: list[str], present: list[str]) -> None:
    """E11 as a guard: raise and name every feature that one list has and the other lacks."""
    diff = feature_consistency(saved, present)
    wrong = [f"{kind} {', '.join(sorted(names))}" for kind, names in diff.items() if names]
    if wrong:
        raise ValueError("the model's features do not fit the table: " + "; ".join(wrong))


def require_features(columns: list[str], features: list[str]) -> None:
    """E11 for scoring: a table may have further columns, but must have the model's features."""
    check_feature_consistency(features, [c for c in columns if c in set(features)])
