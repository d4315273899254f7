"""Per-patient scoring rules (K2-K16, K19) as Column expressions.

Lists (advice, contributors, recommendations) are ``array`` of conditional
``struct``s, filtered for nulls and ordered with ``array_sort``: all JVM
side, no UDF, no explode. Texts are the reference's fixed strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalframe.functions.rounding import half_even


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# Texts of the scoring service and of the assessment form
# --------------------------------------------------------------------------

BP_TEXT = {
    0: "Normal blood pressure.",
    1: "High normal blood pressure.",
    2: "High blood pressure (Stage 1).",
    3: "High blood pressure (Stage 2).",
    4: "Severe hypertension. Seek immediate care.",
}
BP_TEXT_DEFAULT = "Unknown BP status."
CHOLESTEROL_TEXT = {
    1: "Cholesterol is normal.",
    2: "Cholesterol is above normal. Reduce oily foods.",
    3: "Very high cholesterol. Medical review recommended.",
}
CHOLESTEROL_TEXT_DEFAULT = "Unknown cholesterol level."
GLUCOSE_TEXT = {
    1: "Glucose levels within normal range.",
    2: "Glucose above normal. Possible impaired glucose regulation.",
    3: "Elevated glucose levels. Consider glucose tolerance testing.",
}
GLUCOSE_TEXT_DEFAULT = "Unknown glucose level."

ADVICE = {
    "bmi_high": "BMI is high. Begin calorie deficit + daily walking.",
    "bmi_low": "BMI low. Increase healthy calorie intake.",
    "bp": "High blood pressure detected. Reduce salt and fried foods.",
    "chol": "Cholesterol elevated. Increase fiber, avoid fried foods.",
    "gluc": "High sugar levels. Reduce sugar + refined carbs.",
    "smoke": "Smoking increases cardiac risk. Consider quitting.",
    "alco": "Alcohol raises BP. Reduce intake.",
    "inactive": "Increase activity — 30 minutes walking daily.",
    "level_high": "High cardiovascular risk. Medical consultation recommended.",
    "level_moderate": "Moderate risk. Lifestyle changes recommended.",
    "level_low": "Low risk. Maintain healthy habits.",
}

RISK_CONTEXT = {
    "Very High": (
        "This score indicates a significantly elevated cardiovascular risk profile compared to the general population.",
        "A medical evaluation is recommended in the near future to discuss risk factors and preventive options.",
        "This is a risk assessment tool, not a diagnosis. Many individuals with elevated risk profiles maintain good heart health through appropriate lifestyle choices and medical guidance.",
    ),
    "High": (
        "Your cardiovascular risk profile is above average for your demographic group.",
        "Consider discussing these results with your healthcare provider at your next visit.",
        "Lifestyle modifications can significantly improve your risk profile over time.",
    ),
    "Moderate": (
        "Your risk profile is within the expected range but shows some areas for potential improvement.",
        "Focus on the suggested lifestyle adjustments and continue monitoring your health metrics.",
        "Regular monitoring and healthy habits can help maintain or improve your current profile.",
    ),
    "Low": (
        "Your cardiovascular risk profile appears to be favorable.",
        "Continue your current healthy practices.",
        "Maintain regular check-ups to support continued heart health.",
    ),
}

RISK_CONTEXT_V1 = {
    "Very High": (
        "This score indicates a significantly elevated cardiovascular risk compared to the average adult.",
        "Medical evaluation is strongly advised within the next 2 weeks.",
        "This is a risk assessment, not a diagnosis. Many individuals with elevated risk never develop heart disease when they take appropriate action.",
    ),
    "High": (
        "Your cardiovascular risk is above average for your demographic group.",
        "Consider scheduling a check-up with your healthcare provider within the next month.",
        "Lifestyle modifications can significantly reduce this risk over time.",
    ),
    "Moderate": (
        "Your risk level is within the expected range but shows some areas for improvement.",
        "Focus on the recommended lifestyle changes and monitor your health metrics.",
        "Regular monitoring and healthy habits can keep your risk from increasing.",
    ),
    "Low": (
        "Your cardiovascular risk appears to be below average.",
        "Continue your current healthy practices.",
        "Maintain regular check-ups to ensure continued heart health.",
    ),
}

# Recommendations with targets: (list, text, target).
REC_HIGH_BP = ("Consult a healthcare provider about blood pressure management", "Target: < 130/80 mmHg")
REC_HIGH_CHOL = ("Discuss cholesterol management with your doctor", "Target: LDL < 100 mg/dL")
REC_HIGH_SMOKE = ("Consider a smoking cessation program", "Goal: Smoke-free within 3-6 months")
REC_MED_BP = ("Monitor blood pressure and reduce sodium intake", "Target: < 2g sodium/day")
REC_MED_WEIGHT = "Work on gradual weight reduction"
REC_MED_CHOL = ("Increase dietary fiber and reduce saturated fats", "Target: 25-30g fiber/day")
REC_MED_GLUC = ("Reduce sugar and refined carbohydrates", "Target: < 25g added sugar/day")
REC_MED_ALCO = ("Limit alcohol consumption", "Target: < 2 drinks/week")
REC_LONG_INACTIVE = ("Begin regular physical activity", "Target: 30 min walking, 5x/week")
REC_LONG_ACTIVE = ("Maintain current activity, consider adding variety", "Target: 150 min moderate activity/week")
REC_LONG_CHECKUP = ("Schedule regular health monitoring", "Target: Check-up every 6 months")
REC_LONG_TRACK = ("Track key health metrics at home", "Monitor: BP and weight weekly")
REC_HIGH_FILLER = ("Continue current healthy practices", "Maintain regular preventive care")
REC_MED_FILLER = ("Focus on balanced nutrition", "Target: 5 servings fruits/vegetables daily")

# Older form variant: plain strings.
REC1_HIGH_BP = "Consult a physician immediately for hypertension management"
REC1_HIGH_CHOL = "Schedule a lipid panel test and discuss treatment options with your doctor"
REC1_HIGH_SMOKE = "Begin a smoking cessation program - this is the fastest way to reduce risk"
REC1_MED_BP = "Monitor blood pressure daily and reduce sodium intake"
REC1_MED_CHOL = "Increase dietary fiber and reduce saturated fat intake"
REC1_MED_GLUC = "Reduce sugar and refined carbohydrate consumption"
REC1_MED_ALCO = "Limit alcohol to 1-2 drinks per week maximum"
REC1_LONG_INACTIVE = "Begin with 30 minutes of walking daily, gradually increase intensity"
REC1_LONG_ACTIVE = "Maintain current activity level, consider adding strength training"
REC1_LONG_CHECKUP = "Schedule regular health check-ups every 6 months"
REC1_LONG_MONITOR = "Monitor blood pressure and blood glucose at home weekly"
REC1_HIGH_FILLER = "Continue current healthy practices and maintain regular check-ups"
REC1_MED_FILLER = "Focus on maintaining a balanced diet rich in vegetables and lean proteins"

SEVERITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}

# Risk contributors of the assessment form, one entry per rule in the form's
# order: (severity, factor, description, modifiability); "{}" is filled with
# the age, the BP stage or the truncated BMI.
CONTRIBUTORS = {
    "age": ("MEDIUM", "Age", "{} years", "Non-modifiable"),
    "bp_stage_2_plus": ("HIGH", "Blood Pressure", "High blood pressure (Stage {})", "Treatable"),
    "bp_stage_1": ("MEDIUM", "Blood Pressure", "High blood pressure (Stage 1)", "Treatable"),
    "cholesterol_3": ("HIGH", "Cholesterol", "Very high levels", "Modifiable"),
    "cholesterol_2": ("MEDIUM", "Cholesterol", "Above normal", "Modifiable"),
    "bmi_obese": ("HIGH", "BMI", "Obese ({})", "Modifiable"),
    "bmi_overweight": ("MEDIUM", "BMI", "Overweight ({})", "Modifiable"),
    "glucose_3": ("HIGH", "Glucose", "Very high levels", "Modifiable"),
    "glucose_2": ("MEDIUM", "Glucose", "Above normal", "Modifiable"),
    "smoking": ("HIGH", "Smoking", "Active smoker", "Modifiable - Very High Impact"),
    "alcohol": ("MEDIUM", "Alcohol", "Regular consumption", "Modifiable"),
    "inactive": ("LOW", "Physical Activity", "Sedentary lifestyle", "Modifiable"),
}

# Older form variant: (severity, factor, description); "{}" is the BP stage or
# the BMI with one decimal.
CONTRIBUTORS_V1 = {
    "bp_stage_2_plus": ("HIGH", "Blood Pressure", "Stage {} Hypertension"),
    "bp_stage_1": ("MEDIUM", "Blood Pressure", "Elevated blood pressure"),
    "cholesterol_3": ("HIGH", "Cholesterol", "Very high cholesterol levels"),
    "cholesterol_2": ("MEDIUM", "Cholesterol", "Above normal cholesterol"),
    "bmi_obese": ("HIGH", "BMI", "Obese (BMI: {})"),
    "bmi_overweight": ("MEDIUM", "BMI", "Overweight (BMI: {})"),
    "glucose_3": ("HIGH", "Glucose", "Very high glucose levels"),
    "glucose_2": ("MEDIUM", "Glucose", "Above normal glucose"),
    "smoking": ("HIGH", "Smoking", "Active smoker"),
    "alcohol": ("MEDIUM", "Alcohol", "Regular alcohol consumption"),
    "inactive": ("LOW", "Physical Activity", "Sedentary lifestyle"),
}

# Sentences; "{}" is filled with a number.
MESSAGES = {
    "interpretation_low": "The model indicates LOW likelihood of cardiovascular disease (Risk Score: {}%). Maintain healthy habits.",
    "interpretation_high": "The model indicates HIGH likelihood of cardiovascular disease (Risk Score: {}%). Medical consultation recommended.",
    "summary": "Estimated risk: {}% ",
    "weight_target": "Target: -{} kg in 3 months",
    "weight_target_v1": "Target weight reduction of {} kg through diet and exercise",
    "age_higher": "Your risk profile is higher than approximately {}%",
    "age_lower": "Your risk profile is lower than approximately {}%",
    "age_band": " of individuals in the {} to {} age range.",
    "age_higher_v1": "Your estimated risk is higher than approximately {}%",
    "age_lower_v1": "Your estimated risk is lower than approximately {}%",
    "age_band_v1": " of individuals in your age group ({} to {} years).",
    "assessment_high": "Elevated Cardiovascular Risk Identified",
    "assessment_high_v1": "Elevated Risk Detected",
    "assessment_low": "Lower Risk Profile",
    "index_significant": "(Significantly Elevated)",
    "index_moderate": "(Moderately Elevated)",
    "index_expected": "(Within Expected Range)",
}

# Scoring-service texts for the hypotension gate.
GATE_TEXT = {
    "warning": "Hypotension (<90/60). Model not trained for low BP.",
    "risk_level": "Not Applicable",
    "summary": "BP too low for reliable prediction.",
}


def fill(template: str, *values: Column) -> Column:
    """Render a fixed template: each "{}" becomes the next value as text."""
    parts = template.split("{}")
    if len(parts) - 1 != len(values):
        raise ValueError(f"template {template!r} takes {len(parts) - 1} values")
    out = [F.lit(parts[0])]
    for v, tail in zip(values, parts[1:]):
        out += [v.cast("string"), F.lit(tail)]
    return F.concat(*out)


# ------------------------------------------------------------------ K2 - K7

def risk_level(p="probability", suffix: str = "") -> Column:
    """K2: <.3 Low, <.5 Moderate, <.7 High, else Very High (+ optional ' Risk')."""
    p = col(p)
    lv = (F.when(p < 0.3, "Low").when(p < 0.5, "Moderate").when(p < 0.7, "High")
          .otherwise("Very High"))
    return F.concat(lv, F.lit(suffix)) if suffix else lv


def confidence_band(p="probability") -> Column:
    """K3: abs(p - .5) * 2 : >.8 Very High, >.6 High, >.4 Moderate, else Low."""
    s = F.abs(col(p) - 0.5) * 2
    return (F.when(s > 0.8, "Very High").when(s > 0.6, "High").when(s > 0.4, "Moderate")
            .otherwise("Low"))


def pct1(p="probability") -> Column:
    """probability * 100 as text with one decimal."""
    return F.format_string("%.1f", col(p) * 100)


def interpretation(pred="prediction", p="probability") -> Column:
    """K4: sentence by predicted class with the percent to one decimal."""
    return F.when(col(pred) == 0, fill(MESSAGES["interpretation_low"], pct1(p))) \
        .otherwise(fill(MESSAGES["interpretation_high"], pct1(p)))


def prediction_report(pred="prediction", p="probability") -> Column:
    """K5: struct(prediction, probability, risk_level, confidence, interpretation)."""
    return F.struct(
        col(pred).alias("prediction"), col(p).alias("probability"),
        risk_level(p, " Risk").alias("risk_level"), confidence_band(p).alias("confidence"),
        interpretation(pred, p).alias("interpretation"))


def heart_health_score(combined="combined_risk_score") -> Column:
    """K6: 100 - combined, one decimal."""
    return half_even(100 - col(combined), 1)


def heart_health_status(score="heart_health_score") -> Column:
    s = col(score)
    return (F.when(s >= 80, "Excellent").when(s >= 60, "Good").when(s >= 40, "Moderate")
            .when(s >= 20, "Poor").otherwise("Very Poor"))


def _lookup(mapping: dict[int, str], default: str, key) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[col(key).cast("int")], F.lit(default))


def bp_text(bp="bp_category") -> Column:
    """K7."""
    return _lookup(BP_TEXT, BP_TEXT_DEFAULT, bp)


def cholesterol_text(c="cholesterol") -> Column:
    return _lookup(CHOLESTEROL_TEXT, CHOLESTEROL_TEXT_DEFAULT, c)


def glucose_text(g="gluc") -> Column:
    return _lookup(GLUCOSE_TEXT, GLUCOSE_TEXT_DEFAULT, g)


# ------------------------------------------------------------------ K8

def _compact(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def advice_list(bmi="bmi", bp="bp_category", chol="cholesterol", gluc="gluc", smoke="smoke",
                alco="alco", active="active", p="probability") -> Column:
    """K8: conditional messages in fixed order, then one message by risk level."""
    lv = risk_level(p)
    items = [
        F.when(col(bmi) >= 25, F.lit(ADVICE["bmi_high"])).when(col(bmi) < 18.5, F.lit(ADVICE["bmi_low"])),
        F.when(col(bp) >= 2, F.lit(ADVICE["bp"])),
        F.when(col(chol) > 1, F.lit(ADVICE["chol"])),
        F.when(col(gluc) > 1, F.lit(ADVICE["gluc"])),
        F.when(col(smoke) != 0, F.lit(ADVICE["smoke"])),
        F.when(col(alco) != 0, F.lit(ADVICE["alco"])),
        F.when(col(active) == 0, F.lit(ADVICE["inactive"])),
        F.when(lv.isin("High", "Very High"), F.lit(ADVICE["level_high"]))
        .when(lv == "Moderate", F.lit(ADVICE["level_moderate"]))
        .otherwise(F.lit(ADVICE["level_low"])),
    ]
    return _compact(items)


def advice_summary(p="probability") -> Column:
    """'Estimated risk: <pct>% (<level>).'"""
    return F.concat(fill(MESSAGES["summary"], pct1(p)), F.lit("("), risk_level(p), F.lit(")."))


# ------------------------------------------------------------------ K9 / K10

def _contrib(pos: int, severity: str, factor: str, desc: Column, modif: str | None) -> Column:
    fields = [F.lit(SEVERITY_RANK[severity]).alias("rank"), F.lit(pos).alias("pos"),
              F.lit(severity).alias("severity"), F.lit(factor).alias("factor"),
              desc.alias("description")]
    if modif is not None:
        fields.append(F.lit(modif).alias("modifiability"))
    return F.struct(*fields)


def _sorted_without_keys(items: list[Column], keep: list[str]) -> Column:
    arr = F.array_sort(_compact(items))
    return F.transform(arr, lambda x: F.struct(*[x[k].alias(k) for k in keep]))


def _contrib_from(table: dict, key: str, pos: int, *values: Column, with_mod: bool = True) -> Column:
    entry = table[key]
    sev, factor, desc = entry[0], entry[1], entry[2]
    text = fill(desc, *values) if values else F.lit(desc)
    return _contrib(pos, sev, factor, text, entry[3] if with_mod else None)


def risk_contributors(bmi="bmi_raw", bp="bp_category", chol="cholesterol", gluc="gluc",
                      smoke="smoke", alco="alco", active="active", age="age") -> Column:
    """K9: ranked (severity, factor, description, modifiability); HIGH, MEDIUM, LOW, stable."""
    bpc, b = col(bp), col(bmi)
    c = lambda key, pos, *v: _contrib_from(CONTRIBUTORS, key, pos, *v)
    items = [
        F.when(col(age) >= 55, c("age", 0, col(age))),
        F.when(bpc >= 3, c("bp_stage_2_plus", 1, bpc - 1)).when(bpc == 2, c("bp_stage_1", 1)),
        F.when(col(chol) == 3, c("cholesterol_3", 2)).when(col(chol) == 2, c("cholesterol_2", 2)),
        F.when(b >= 30, c("bmi_obese", 3, b.cast("int"))).when(b >= 25, c("bmi_overweight", 3, b.cast("int"))),
        F.when(col(gluc) == 3, c("glucose_3", 4)).when(col(gluc) == 2, c("glucose_2", 4)),
        F.when(col(smoke) == 1, c("smoking", 5)),
        F.when(col(alco) == 1, c("alcohol", 6)),
        F.when(col(active) == 0, c("inactive", 7)),
    ]
    return _sorted_without_keys(items, ["severity", "factor", "description", "modifiability"])


def risk_contributors_v1(bmi="bmi_raw", bp="bp_category", chol="cholesterol", gluc="gluc",
                         smoke="smoke", alco="alco", active="active") -> Column:
    """Older variant: no age rule, 3 fields, BMI shown with one decimal."""
    bpc, b = col(bp), col(bmi)
    bmi1 = F.format_string("%.1f", b)
    c = lambda key, pos, *v: _contrib_from(CONTRIBUTORS_V1, key, pos, *v, with_mod=False)
    items = [
        F.when(bpc >= 3, c("bp_stage_2_plus", 1, bpc - 1)).when(bpc == 2, c("bp_stage_1", 1)),
        F.when(col(chol) == 3, c("cholesterol_3", 2)).when(col(chol) == 2, c("cholesterol_2", 2)),
        F.when(b >= 30, c("bmi_obese", 3, bmi1)).when(b >= 25, c("bmi_overweight", 3, bmi1)),
        F.when(col(gluc) == 3, c("glucose_3", 4)).when(col(gluc) == 2, c("glucose_2", 4)),
        F.when(col(smoke) == 1, c("smoking", 5)),
        F.when(col(alco) == 1, c("alcohol", 6)),
        F.when(col(active) == 0, c("inactive", 7)),
    ]
    return _sorted_without_keys(items, ["severity", "factor", "description"])


# ------------------------------------------------------------------ K11 / K12

def _rec(pair) -> Column:
    text, target = pair
    return F.struct(F.lit(text).alias("text"), F.lit(target).alias("target"))


def _with_filler(items: list[Column], filler: Column) -> Column:
    arr = _compact(items)
    return F.when(F.size(arr) == 0, F.array(filler)).otherwise(arr)


def recommendations(bmi="bmi_raw", bp="bp_category", chol="cholesterol", gluc="gluc",
                    smoke="smoke", alco="alco", active="active") -> Column:
    """struct(high, medium, long_term) of (text, target) lists with fillers."""
    bpc, b = col(bp), col(bmi)
    loss = F.greatest(F.lit(3), ((b - 24) * 1.5).cast("int"))
    weight = F.struct(F.lit(REC_MED_WEIGHT).alias("text"),
                      fill(MESSAGES["weight_target"], loss).alias("target"))
    high = _with_filler([
        F.when(bpc >= 3, _rec(REC_HIGH_BP)),
        F.when(col(chol) == 3, _rec(REC_HIGH_CHOL)),
        F.when(col(smoke) == 1, _rec(REC_HIGH_SMOKE)),
    ], _rec(REC_HIGH_FILLER))
    medium = _with_filler([
        F.when(bpc >= 2, _rec(REC_MED_BP)),
        F.when(b >= 25, weight),
        F.when(col(chol) == 2, _rec(REC_MED_CHOL)),
        F.when(col(gluc) >= 2, _rec(REC_MED_GLUC)),
        F.when(col(alco) == 1, _rec(REC_MED_ALCO)),
    ], _rec(REC_MED_FILLER))
    long_term = F.array(
        F.when(col(active) == 0, _rec(REC_LONG_INACTIVE)).otherwise(_rec(REC_LONG_ACTIVE)),
        _rec(REC_LONG_CHECKUP), _rec(REC_LONG_TRACK))
    return F.struct(high.alias("high"), medium.alias("medium"), long_term.alias("long_term"))


def recommendations_v1(bmi="bmi_raw", bp="bp_category", chol="cholesterol", gluc="gluc",
                       smoke="smoke", alco="alco", active="active") -> Column:
    """Older variant: plain strings; weight target max(5, int((bmi - 24) * 2)); BP medium only at class 2."""
    bpc, b = col(bp), col(bmi)
    L = F.lit
    loss = F.greatest(L(5), ((b - 24) * 2).cast("int"))
    high = _with_filler([F.when(bpc >= 3, L(REC1_HIGH_BP)), F.when(col(chol) == 3, L(REC1_HIGH_CHOL)),
                         F.when(col(smoke) == 1, L(REC1_HIGH_SMOKE))], L(REC1_HIGH_FILLER))
    medium = _with_filler([
        F.when(bpc == 2, L(REC1_MED_BP)),
        F.when(b >= 25, fill(MESSAGES["weight_target_v1"], loss)),
        F.when(col(chol) == 2, L(REC1_MED_CHOL)),
        F.when(col(gluc) >= 2, L(REC1_MED_GLUC)),
        F.when(col(alco) == 1, L(REC1_MED_ALCO)),
    ], L(REC1_MED_FILLER))
    long_term = F.array(F.when(col(active) == 0, L(REC1_LONG_INACTIVE)).otherwise(L(REC1_LONG_ACTIVE)),
                        L(REC1_LONG_CHECKUP), L(REC1_LONG_MONITOR))
    return F.struct(high.alias("high"), medium.alias("medium"), long_term.alias("long_term"))


# ------------------------------------------------------------------ K13 - K16

def age_percentile(age="age", p="probability") -> Column:
    """Heuristic percentile in 1..99 (truncated)."""
    a, base = col(age), col(p) * 100
    pct = (F.when(a < 40, F.least(F.lit(95.0), base + 15))
           .when(a < 50, F.least(F.lit(95.0), base + 10))
           .when(a < 60, base + 5)
           .otherwise(F.greatest(F.lit(50.0), base - 5)))
    return F.least(F.lit(99.0), F.greatest(F.lit(1.0), pct)).cast("int")


def age_comparison(age="age", pct="age_percentile") -> Column:
    """Sentence comparing with the age band age +/- 5."""
    a, q = col(age), col(pct)
    band = fill(MESSAGES["age_band"], a - 5, a + 5)
    return F.when(q >= 50, F.concat(fill(MESSAGES["age_higher"], q), band)) \
        .otherwise(F.concat(fill(MESSAGES["age_lower"], 100 - q), band))


def age_comparison_v1(age="age", pct="age_percentile") -> Column:
    """K14 older variant: three tiers (>= 75 warning tier shares the sentence)."""
    a, q = col(age), col(pct)
    band = fill(MESSAGES["age_band_v1"], a - 5, a + 5)
    hi = F.concat(fill(MESSAGES["age_higher_v1"], q), band)
    lo = F.concat(fill(MESSAGES["age_lower_v1"], 100 - q), band)
    tier = F.when(q >= 75, "warning").when(q >= 50, "info").otherwise("success")
    return F.struct(tier.alias("tier"), F.when(q >= 50, hi).otherwise(lo).alias("text"))


def risk_context(level="risk_level", variant: str = "current") -> Column:
    """(meaning, action, note) by level; unknown levels get the Moderate text."""
    table = RISK_CONTEXT if variant == "current" else RISK_CONTEXT_V1
    lv = col(level)

    def pick(i):
        e = F.lit(table["Moderate"][i])
        for k in ("Very High", "High", "Low"):
            e = F.when(lv == k, F.lit(table[k][i])).otherwise(e)
        return e

    return F.struct(pick(0).alias("meaning"), pick(1).alias("action"), pick(2).alias("note"))


def assessment_label(pred="prediction", variant: str = "current") -> Column:
    """Class -> text (the older form says 'Detected')."""
    hi = MESSAGES["assessment_high"] if variant == "current" else MESSAGES["assessment_high_v1"]
    return F.when(col(pred) == 1, F.lit(hi)).otherwise(F.lit(MESSAGES["assessment_low"]))


def risk_index_text(p="probability", variant: str = "current") -> Column:
    """int(p * 100) with its band; the older form shows p * 100 to one decimal."""
    if variant == "current":
        pct = (col(p) * 100).cast("int")
        shown = pct.cast("string")
    else:
        pct = col(p) * 100
        shown = F.format_string("%.1f", pct)
    return F.concat(shown, F.lit("% "),
                    F.when(pct >= 70, F.lit(MESSAGES["index_significant"]))
                    .when(pct >= 50, F.lit(MESSAGES["index_moderate"]))
                    .otherwise(F.lit(MESSAGES["index_expected"])))


# ------------------------------------------------------------------ K19

def top_k(arr, k: int) -> Column:
    return F.slice(col(arr), 1, k)


def cut_text(c: Column, n: int = 65) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
