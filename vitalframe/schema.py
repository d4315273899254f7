"""Schemas, domains, ranges and feature lists.

Everything under "Fixed values" must equal the reference pipeline's
configuration for results to match; it is stated here plainly, in the
reference's own order (the order matters for the rejection report).
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values (data configuration of the reference pipeline)
# --------------------------------------------------------------------------

RAW_COLUMNS = [
    "id", "age", "gender", "height", "weight", "ap_hi", "ap_lo",
    "cholesterol", "gluc", "smoke", "alco", "active", "cardio",
]

# Declared dtypes: int64 everywhere except weight (float64).
RAW_DTYPES = {c: ("double" if c == "weight" else "bigint") for c in RAW_COLUMNS}

# Valid categorical values, in configuration order.
CATEGORICAL_DOMAINS: dict[str, list[int]] = {
    "gender": [1, 2],
    "cholesterol": [1, 2, 3],
    "gluc": [1, 2, 3],
    "smoke": [0, 1],
    "alco": [0, 1],
    "active": [0, 1],
    "cardio": [0, 1],
}

# Inclusive valid ranges.
VALID_RANGES: dict[str, tuple[float, float]] = {
    "age_days": (10950, 25550),
    "age_years": (30, 70),
    "height": (140, 210),
    "weight": (40, 200),
    "ap_hi": (90, 200),
    "ap_lo": (60, 130),
    "bmi": (15, 50),
}

# Range rules the cleaner applies, in order: (column, range key, report key).
RANGE_RULES: list[tuple[str, str, str]] = [
    ("age_years", "age_years", "age"),
    ("height", "height", "height"),
    ("weight", "weight", "weight"),
    ("ap_hi", "ap_hi", "systolic_bp"),
    ("ap_lo", "ap_lo", "diastolic_bp"),
]

# Quality thresholds.
MAX_MISSING_PERCENTAGE = 5
MIN_UNIQUE_CATEGORICAL = 2
DUPLICATE_THRESHOLD = 0.01  # fraction; compared as percent (x 100)

AGE_DAYS_PER_YEAR = 365.25

# Integer columns after cleaning (truncating cast), plus weight as double.
CLEAN_INT_COLUMNS = [
    "id", "age", "gender", "height", "ap_hi", "ap_lo", "cholesterol", "gluc",
    "smoke", "alco", "active", "cardio", "age_years",
]

# Model input: the 20 feature columns, in training order.
MODEL_FEATURES = [
    "age_years", "gender", "height", "weight", "ap_hi", "ap_lo",
    "cholesterol", "gluc", "smoke", "alco", "active",
    "bmi", "bmi_category", "pulse_pressure", "mean_arterial_pressure",
    "bp_category", "age_group", "lifestyle_risk_score",
    "metabolic_risk_score", "combined_risk_score",
]

# Engineered features, in creation order.
ENGINEERED_FEATURES = [
    "bmi", "bmi_category", "bsa", "weight_height_ratio",
    "pulse_pressure", "mean_arterial_pressure", "bp_category", "bp_ratio",
    "age_group", "age_squared",
    "lifestyle_risk_score", "metabolic_risk_score", "combined_risk_score",
    "age_adjusted_risk",
    "age_bmi_interaction", "age_bp_interaction", "gender_bmi_interaction",
    "smoke_chol_interaction",
]

# Recommended feature order by expected importance.
FEATURE_IMPORTANCE_ORDER = [
    "age_years", "bp_category", "mean_arterial_pressure",
    "ap_hi", "ap_lo", "bmi", "bmi_category",
    "cholesterol", "gluc", "combined_risk_score",
    "age_adjusted_risk", "lifestyle_risk_score",
    "metabolic_risk_score", "pulse_pressure",
    "gender", "smoke", "age_bmi_interaction",
    "age_bp_interaction", "weight", "height",
    "active", "alco",
]

FEATURE_DESCRIPTIONS = {
    "bmi": "Body Mass Index (kg/m²)",
    "bmi_category": "BMI category: 0=Underweight, 1=Normal, 2=Overweight, 3=Obese",
    "bsa": "Body Surface Area (m²)",
    "weight_height_ratio": "Weight-to-height ratio (%)",
    "pulse_pressure": "Systolic - Diastolic BP (mmHg)",
    "mean_arterial_pressure": "Mean Arterial Pressure (mmHg)",
    "bp_category": "BP: 0=Normal, 1=Elevated, 2=Stage1, 3=Stage2, 4=Crisis",
    "bp_ratio": "Systolic / Diastolic ratio",
    "age_group": "Age: 0=<40, 1=40-49, 2=50-59, 3=60+",
    "age_squared": "Age squared (polynomial feature)",
    "lifestyle_risk_score": "Sum of smoking, alcohol, inactivity",
    "metabolic_risk_score": "Sum of cholesterol and glucose levels",
    "combined_risk_score": "Weighted composite risk (0-100)",
    "age_adjusted_risk": "Risk score adjusted for patient age",
    "age_bmi_interaction": "Age × BMI interaction",
    "age_bp_interaction": "Age × Mean BP interaction",
    "gender_bmi_interaction": "Gender × BMI category interaction",
    "smoke_chol_interaction": "Smoking × Cholesterol interaction",
}

# Score-request bounds (inclusive); age is in years here.
REQUEST_BOUNDS: dict[str, tuple[float, float]] = {
    "age": (18, 100),
    "height": (120, 220),
    "weight": (30, 250),
    "ap_hi": (60, 250),
    "ap_lo": (30, 200),
    "cholesterol": (1, 3),
    "gluc": (1, 3),
    "smoke": (0, 1),
    "alco": (0, 1),
    "active": (0, 1),
}

# Preprocessing.
TEST_SIZE = 0.2
VALIDATION_SIZE = 0.15
RANDOM_STATE = 42
CV_FOLDS = 5
CLASSIFICATION_THRESHOLD = 0.5

# --------------------------------------------------------------------------
# Spark schemas
# --------------------------------------------------------------------------

RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType() if c == "weight" else T.LongType(), True)
     for c in RAW_COLUMNS]
)

# Raw file read with every column as text, for untrusted files.
RAW_STRING_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType(), True),
    T.StructField("age", T.LongType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("height", T.DoubleType(), True),
    T.StructField("weight", T.DoubleType(), True),
    T.StructField("ap_hi", T.LongType(), True),
    T.StructField("ap_lo", T.LongType(), True),
    T.StructField("cholesterol", T.LongType(), True),
    T.StructField("gluc", T.LongType(), True),
    T.StructField("smoke", T.LongType(), True),
    T.StructField("alco", T.LongType(), True),
    T.StructField("active", T.LongType(), True),
])

# Request files: the text of a line that is no request is kept for tracing.
MALFORMED = "malformed"
REQUEST_FILE_SCHEMA = T.StructType([*REQUEST_SCHEMA.fields, T.StructField(MALFORMED, T.StringType(), True)])

SCORE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("probability", T.DoubleType(), True),
    T.StructField("prediction", T.IntegerType(), True),
])
