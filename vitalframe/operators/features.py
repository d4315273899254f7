"""Feature derivation operators.

``add_features`` is one projection: all 18 derived columns are computed in a
single ``select`` (no per-row Python, one codegen stage, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.functions import clinical as fx
from vitalframe.schema import (
    ENGINEERED_FEATURES,
    FEATURE_DESCRIPTIONS,
    FEATURE_IMPORTANCE_ORDER,
    MODEL_FEATURES,
)


def add_features(df: DataFrame, create_bmi: bool = True, create_bp_features: bool = True,
                 create_age_groups: bool = True, create_risk_scores: bool = True,
                 bp_profile: str = "train") -> DataFrame:
    """BMI, BP, age and risk groups gated by flags; interactions always.

    Interactions need bmi, mean_arterial_pressure and bmi_category, and the
    combined risk score needs bp_category and bmi_category; missing
    prerequisites are reported up front instead of failing mid-plan.
    """
    cols = set(df.columns)
    have_bmi = create_bmi or {"bmi", "bmi_category"} <= cols
    have_bp = create_bp_features or {"mean_arterial_pressure", "bp_category"} <= cols
    if not (have_bmi and have_bp):
        raise ValueError(
            "interaction features need bmi, bmi_category and mean_arterial_pressure: "
            "enable create_bmi and create_bp_features or supply the columns")
    if create_risk_scores and not (have_bmi and have_bp):
        raise ValueError("combined_risk_score needs bp_category and bmi_category")

    # Stage the dependent columns so each expression refers to a named column;
    # Catalyst collapses the projections into one.
    out = df
    if create_bmi:
        out = out.withColumn("bmi", fx.bmi())
        out = out.withColumns({
            "bmi_category": fx.bmi_category(),
            "bsa": fx.bsa(),
            "weight_height_ratio": fx.weight_height_ratio(),
        })
    if create_bp_features:
        out = out.withColumn("pulse_pressure", fx.pulse_pressure())
        out = out.withColumns({
            "mean_arterial_pressure": fx.mean_arterial_pressure(),
            "bp_category": fx.bp_category(bp_profile),
            "bp_ratio": fx.bp_ratio(),
        })
    if create_age_groups:
        out = out.withColumns({"age_group": fx.age_group(), "age_squared": fx.age_squared()})
    if create_risk_scores:
        out = out.withColumns({
            "lifestyle_risk_score": fx.lifestyle_risk_score(),
            "metabolic_risk_score": fx.metabolic_risk_score(),
        })
        out = out.withColumn("combined_risk_score", fx.combined_risk_score())
        out = out.withColumn("age_adjusted_risk", fx.age_adjusted_risk())
    out = out.withColumns({
        "age_bmi_interaction": fx.age_bmi_interaction(),
        "age_bp_interaction": fx.age_bp_interaction(),
        "gender_bmi_interaction": fx.gender_bmi_interaction(),
        "smoke_chol_interaction": fx.smoke_chol_interaction(),
    })
    return out


def select_model_features(df: DataFrame, feature_columns: list[str] | None = None,
                          label: str | None = "cardio", keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep the feature columns that exist (error if none), plus label / keys."""
    wanted = MODEL_FEATURES if feature_columns is None else feature_columns
    present = [c for c in wanted if c in df.columns]
    if not present:
        raise ValueError("No valid feature columns found")
    extra = [c for c in keep if c in df.columns and c not in present]
    lab = [label] if label and label in df.columns else []
    return df.select(*extra, *present, *lab)


def serving_features(requests: DataFrame, bp_profile: str = "serve",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """score requests (age in years, gender text) -> the 20 model columns.

    Keeps ``request_id`` (or ``id``) and any ``keep`` columns, so results can
    be tied back to requests without a join.
    """
    keys = [c for c in ("request_id", "id") if c in requests.columns]
    keys += [c for c in keep if c in requests.columns and c not in keys]
    base = requests.select(
        *keys,
        F.col("age").cast("bigint").alias("age_years"),
        fx.gender_code("gender").alias("gender"),
        F.col("height").cast("double").alias("height"),
        F.col("weight").cast("double").alias("weight"),
        *[F.col(c).cast("bigint").alias(c)
          for c in ("ap_hi", "ap_lo", "cholesterol", "gluc", "smoke", "alco", "active")],
    )
    feat = (
        base.withColumn("bmi", fx.bmi())
        .withColumn("bmi_category", fx.bmi_category())
        .withColumn("pulse_pressure", fx.pulse_pressure())
        .withColumns({
            "mean_arterial_pressure": fx.mean_arterial_pressure(),
            "bp_category": fx.bp_category(bp_profile),
            "age_group": fx.age_group(),
            "lifestyle_risk_score": fx.lifestyle_risk_score(),
            "metabolic_risk_score": fx.metabolic_risk_score(),
        })
        .withColumn("combined_risk_score", fx.combined_risk_score())
    )
    return feat.select(*keys, *MODEL_FEATURES)


def feature_catalog(spark: SparkSession) -> DataFrame:
    """(feature, importance_rank, description, engineered) for every known feature.

    A small, fixed-size table (the catalog's size is set by the feature list).
    """
    names = list(dict.fromkeys(FEATURE_IMPORTANCE_ORDER + ENGINEERED_FEATURES))
    rows = [
        (n,
         FEATURE_IMPORTANCE_ORDER.index(n) + 1 if n in FEATURE_IMPORTANCE_ORDER else None,
         FEATURE_DESCRIPTIONS.get(n),
         n in ENGINEERED_FEATURES,
         ENGINEERED_FEATURES.index(n) + 1 if n in ENGINEERED_FEATURES else None)
        for n in names
    ]
    return spark.createDataFrame(
        rows, "feature string, importance_rank int, description string, "
              "engineered boolean, creation_order int")


def bp_profile_skew(featured_clean: DataFrame) -> DataFrame:
    """Counts of rows by (training BP class, serving BP class): the train/serve skew."""
    return featured_clean.groupBy(
        fx.bp_category_train().alias("bp_category_train"),
        fx.bp_category_serve().alias("bp_category_serve"),
    ).agg(F.count(F.lit(1)).alias("rows"))
