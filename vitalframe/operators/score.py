"""Scoring operators (K1, K5-K19, C11-C12 routing).

Scoring a population is one projection per row: the hypotension gate and
request validation route rows with ``when``; features, probability, risk
level, contributors and recommendations are column expressions. What-if
scenarios (K18) are generated with a bounded ``explode`` (at most four per
patient) that carries the base probability along, so no self-join is needed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.functions import rules
from vitalframe.functions.rounding import half_even, r6
from vitalframe.operators.clean import hypotension, request_violation
from vitalframe.operators.features import serving_features
from vitalframe.schema import CLASSIFICATION_THRESHOLD, MODEL_FEATURES


@dataclass
class LinearRiskModel:
    """Logistic model as column expressions: p = 1 / (1 + exp(-(b + sum w_i * z_i))).

    ``z_i`` is the raw feature, or ``(x - center) / scale`` when scaling
    statistics are attached (a fitted Spark ML logistic regression on scaled
    features converts to this with ``from_spark_lr``). Scoring is then pure
    codegen arithmetic: no vector assembly, no Python.
    """
    intercept: float
    weights: dict[str, float]
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    threshold: float = CLASSIFICATION_THRESHOLD
    # Report probabilities to this many decimals (half-even); None keeps full
    # precision. Rounding makes ties identical across engines whose exp()
    # differ in the last bit.
    round_digits: int | None = None

    def margin(self) -> Column:
        z = F.lit(float(self.intercept))
        for c, w in self.weights.items():
            x = F.col(c).cast("double")
            if c in self.center:
                x = (x - F.lit(self.center[c])) / F.lit(self.scale.get(c, 1.0))
            z = z + F.lit(float(w)) * x
        return z

    def probability(self) -> Column:
        p = 1 / (1 + F.exp(-self.margin()))
        return half_even(p, self.round_digits) if self.round_digits is not None else p

    def prediction(self, p: Column | None = None) -> Column:
        p = self.probability() if p is None else p
        return (p > F.lit(self.threshold)).cast("int")

    def to_json(self) -> str:
        return json.dumps({"intercept": self.intercept, "weights": self.weights,
                           "center": self.center, "scale": self.scale,
                           "threshold": self.threshold, "round_digits": self.round_digits})

    @staticmethod
    def from_json(s: str) -> "LinearRiskModel":
        d = json.loads(s)
        return LinearRiskModel(d["intercept"], d["weights"], d.get("center", {}),
                               d.get("scale", {}), d.get("threshold", CLASSIFICATION_THRESHOLD),
                               d.get("round_digits"))

    @staticmethod
    def from_spark_lr(lr_model, features: list[str], center: dict | None = None,
                      scale: dict | None = None) -> "LinearRiskModel":
        coefs = lr_model.coefficients.toArray().tolist()
        return LinearRiskModel(float(lr_model.intercept), dict(zip(features, coefs)),
                               dict(center or {}), dict(scale or {}))


# An illustrative fixed model used where results must be reproducible in SQL
# (evaluation and scoring checks). Fitted models replace it in production.
DEFAULT_RISK_MODEL = LinearRiskModel(
    intercept=-8.0,
    weights={
        "age_years": 0.05,
        "ap_hi": 0.025,
        "mean_arterial_pressure": 0.01,
        "cholesterol": 0.35,
        "gluc": 0.1,
        "bmi": 0.03,
        "smoke": 0.15,
        "alco": 0.1,
        "active": -0.25,
    },
    round_digits=12,
)


def score_table(df: DataFrame, model: LinearRiskModel = DEFAULT_RISK_MODEL,
                id_col: str = "id", label_col: str = "cardio",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, label, probability, prediction) + kept columns, for the E operators."""
    p = model.probability()
    return df.select(
        *keep, F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"),
        p.alias("probability"),
    ).withColumn("prediction", model.prediction(F.col("probability")))


# ------------------------------------------------------------------ requests

def requests_from_patients(raw: DataFrame) -> DataFrame:
    """Score requests in the service's input shape, one per raw patient row.

    age becomes years (half-even of days / 365.25) and gender text
    ('male' for code 2, 'female' otherwise); other fields pass through, so
    out-of-bound and missing values reach request validation unchanged.
    """
    from vitalframe.functions.clinical import age_years
    return raw.select(
        F.col("id").alias("request_id"),
        age_years("age").alias("age"),
        F.when(F.col("gender") == 2, "male").otherwise("female").alias("gender"),
        F.col("height").cast("double").alias("height"),
        F.col("weight").cast("double").alias("weight"),
        *[F.col(c) for c in ("ap_hi", "ap_lo", "cholesterol", "gluc", "smoke", "alco", "active")],
    )


def score_requests(requests: DataFrame, model: LinearRiskModel = DEFAULT_RISK_MODEL,
                   bp_profile: str = "serve") -> DataFrame:
    """K1 + C11 + C12 + K2 + K6-K8: one response row per request.

    ``status`` is 'rejected' (with ``rejection``), 'not_applicable' (the
    hypotension gate: no score, warning text) or 'scored'. Rejected and
    gated rows carry null scores; all routes come out of one projection.
    """
    base = requests.withColumns({
        "rejection": request_violation(requests.columns),
        "req_height": F.col("height"), "req_weight": F.col("weight"),
    })
    x = serving_features(base, bp_profile, keep=("rejection", "req_height", "req_weight"))
    status = (F.when(F.col("rejection").isNotNull(), "rejected")
              .when(hypotension(), "not_applicable").otherwise("scored"))
    x = x.withColumn("status", status)
    ok = F.col("status") == "scored"
    gated = F.col("status") == "not_applicable"
    x = x.withColumn("probability", F.when(ok, model.probability()))
    hh = rules.heart_health_score()
    return x.select(
        "request_id", "status", "rejection",
        F.when(gated, F.lit(rules.GATE_TEXT["warning"])).alias("warning"),
        F.when(ok, model.prediction(F.col("probability"))).alias("prediction"),
        F.col("probability"),
        F.when(ok, rules.risk_level()).when(gated, F.lit(rules.GATE_TEXT["risk_level"])).alias("risk_level"),
        F.when(ok, rules.advice_summary()).when(gated, F.lit(rules.GATE_TEXT["summary"])).alias("summary"),
        F.when(ok, F.struct(hh.alias("score"), rules.heart_health_status(hh).alias("status")))
        .alias("heart_health"),
        F.when(ok, rules.bp_text()).alias("bp_interpretation"),
        F.when(ok, rules.cholesterol_text()).alias("cholesterol_interpretation"),
        F.when(ok, rules.glucose_text()).alias("glucose_interpretation"),
        F.when(ok, F.struct(F.col("bmi"), F.col("bmi_category"),
                            F.col("bp_category").alias("blood_pressure_category"),
                            F.col("combined_risk_score"))).alias("risk_factors"),
        F.when(ok, rules.advice_list()).alias("recommendations"),
        F.col("age_years").alias("age"), "gender", "ap_hi", "ap_lo", "cholesterol", "gluc",
        "smoke", "alco", "active", "bmi", "bp_category",
        F.col("req_height").alias("height"), F.col("req_weight").alias("weight"),
    )


def assessment(responses: DataFrame, variant: str = "current") -> DataFrame:
    """K9-K16 on scored responses: contributors, prioritised recommendations,
    age percentile and sentence, risk context, assessment label and index.

    The form recomputes BMI without rounding from the entered height and
    weight, and takes the BP class from the response (serving profile).
    """
    r = responses.where(F.col("status") == "scored").withColumn(
        "bmi_raw", F.col("weight") / ((F.col("height") / 100) * (F.col("height") / 100)))
    r = r.withColumn("age_percentile", rules.age_percentile("age", "probability"))
    if variant == "current":
        contrib = rules.risk_contributors(age="age")
        recs = rules.recommendations()
        cmp_ = rules.age_comparison("age", "age_percentile")
    else:
        contrib = rules.risk_contributors_v1()
        recs = rules.recommendations_v1()
        cmp_ = rules.age_comparison_v1("age", "age_percentile")
    return r.select(
        "request_id", "probability", "prediction", "risk_level",
        rules.assessment_label(variant=variant).alias("assessment"),
        rules.risk_index_text(variant=variant).alias("risk_index"),
        rules.risk_context("risk_level", variant).alias("risk_context"),
        "age_percentile", cmp_.alias("age_comparison"),
        contrib.alias("contributors"), recs.alias("action_plan"),
        "age", "gender", "height", "weight", "ap_hi", "ap_lo",
    )


def prediction_reports(scored: DataFrame) -> DataFrame:
    """K5: one report struct per scored row (id, label, probability, prediction)."""
    return scored.select("id", rules.prediction_report().alias("report"))


# ------------------------------------------------------------------ K17 / K18

# What-if scenarios of the assessment form, in display order:
# (name, title when the estimate moved, note, generic title, generic note).
SCENARIO_TEXT = {
    "quit_smoking": ("If you quit smoking", "Significant long-term cardiovascular benefit",
                     "Quit Smoking", "Reduces long-term cardiovascular risk by up to 50% within 5 years"),
    "become_active": ("If you become active", "Regular physical activity improves cardiovascular function",
                      "Regular Physical Activity",
                      "Reduces heart disease risk by 30-40% through improved cardiovascular function"),
    "bp_reduction": ("If BP reduced by 15 mmHg", "Blood pressure management is highly effective",
                     "Lower Blood Pressure",
                     "Reducing BP by 10-15 mmHg significantly lowers stroke and heart attack risk"),
    "combined": ("Combined: Quit smoking + BP reduction",
                 "Combining multiple lifestyle changes produces compounding health benefits", None, None),
    "optimal": (None, None, "Optimal Lifestyle",
                "Your current lifestyle choices are already optimal. Keep up the great work!"),
}
BP_STEP = 15


def what_if_transform(smoke: Column, active: Column, reduction: Column) -> dict[str, Column]:
    """Overridden smoke / active, and BP lowered by ``reduction`` with floors 90 / 60."""
    return {
        "smoke": smoke, "active": active,
        "ap_hi": F.greatest(F.lit(90), F.col("ap_hi") - reduction),
        "ap_lo": F.greatest(F.lit(60), F.col("ap_lo") - (reduction * 0.6).cast("int")),
    }


def what_if(requests: DataFrame, model: LinearRiskModel = DEFAULT_RISK_MODEL,
            bp_profile: str = "serve") -> DataFrame:
    """Applicable scenarios per scored request, each re-scored once, in bulk.

    Scenario rows come from ``explode`` over at most four conditional
    structs per patient (plus 'optimal' when none applies), carrying the base
    probability, so the comparison needs no join back to the base rows.
    """
    s = score_requests(requests, model, bp_profile).where(F.col("status") == "scored")
    smoke, active, hi = F.col("smoke"), F.col("active"), F.col("ap_hi")

    def sc(name, order, new_smoke, new_active, red, min_drop):
        return F.struct(F.lit(name).alias("scenario"), F.lit(order).alias("ord"),
                        new_smoke.cast("bigint").alias("s_smoke"),
                        new_active.cast("bigint").alias("s_active"),
                        F.lit(red).alias("s_red"), F.lit(float(min_drop)).alias("min_drop"))

    arr = F.array(
        F.when(smoke == 1, sc("quit_smoking", 1, F.lit(0), active, 0, 1)),
        F.when(active == 0, sc("become_active", 2, smoke, F.lit(1), 0, 1)),
        F.when(hi > 130, sc("bp_reduction", 3, smoke, active, BP_STEP, 1)),
        F.when((smoke == 1) & (hi > 130), sc("combined", 4, F.lit(0), active, BP_STEP, 2)),
        F.when((smoke != 1) & (active != 0) & (hi <= 130), sc("optimal", 5, smoke, active, 0, 0)),
    )
    x = s.select(
        "request_id", F.col("probability").alias("base_probability"),
        "age", F.when(F.col("gender") == 2, "male").otherwise("female").alias("gender"),
        "height", "weight", "ap_hi", "ap_lo", "cholesterol", "gluc", "alco", "smoke", "active",
        F.explode(F.filter(arr, lambda e: e.isNotNull())).alias("sc"))
    mod = x.withColumns(what_if_transform(F.col("sc.s_smoke"), F.col("sc.s_active"), F.col("sc.s_red")))
    mod = mod.select("request_id", "base_probability", "sc.scenario", "sc.ord", "sc.min_drop",
                     "age", "gender", "height", "weight", "ap_hi", "ap_lo", "cholesterol", "gluc",
                     "alco", "smoke", "active")
    feats = serving_features(mod, bp_profile,
                             keep=("scenario", "ord", "min_drop", "base_probability"))
    is_opt = F.col("scenario") == "optimal"
    new_p = F.when(~is_opt, model.probability())
    out = feats.select("request_id", "scenario", "ord", "base_probability", "min_drop",
                       new_p.alias("new_probability"))
    red = F.col("base_probability") * 100 - F.col("new_probability") * 100
    out = out.withColumn("reduction", red)
    moved = F.col("reduction") > F.col("min_drop")

    def text(i):
        m = F.create_map(*[x for k, v in SCENARIO_TEXT.items() for x in (F.lit(k), F.lit(v[i]))])
        return m[F.col("scenario")]

    numeric = F.concat(text(0), F.lit(": "), (F.col("new_probability") * 100).cast("int").cast("string"),
                       F.lit("% (↓"), F.col("reduction").cast("int").cast("string"), F.lit("% reduction)"))
    shown = is_opt | moved | (F.col("scenario") != "combined")
    return out.select(
        "request_id", "scenario", "ord",
        r6(F.col("base_probability")).alias("base_probability"),
        r6(F.col("new_probability")).alias("new_probability"),
        r6(F.col("reduction")).alias("reduction"),
        shown.alias("shown"),
        F.when(is_opt, F.lit(False)).otherwise(moved).alias("estimate_moved"),
        F.when(~is_opt & moved, numeric).when(shown, text(2)).alias("title"),
        F.when(~is_opt & moved, text(1)).when(shown, text(3)).alias("note"),
    )


# ------------------------------------------------------------------ S10

def text_report(responses: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """The plain-text assessment report per scored request (one string each).

    ``generated_at`` defaults to the current timestamp; pass a literal for
    reproducible output.
    """
    x = assessment(responses)
    ts = generated_at if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm")
    line = F.lit("=" * 60)
    gender_txt = F.when(F.col("gender") == 2, "Male").otherwise("Female")
    contrib = F.transform(F.col("contributors"), lambda c: F.concat(
        F.lit("["), c["severity"], F.lit("] "), c["factor"], F.lit(": "), c["description"],
        F.lit(" ("), c["modifiability"], F.lit(")")))
    high = F.transform(F.col("action_plan.high"), lambda r_: F.concat_ws(
        "\n", F.concat(F.lit("  - "), r_["text"]), F.concat(F.lit("    "), r_["target"])))
    med = F.transform(F.col("action_plan.medium"), lambda r_: F.concat_ws(
        "\n", F.concat(F.lit("  - "), r_["text"]), F.concat(F.lit("    "), r_["target"])))
    body = F.concat_ws(
        "\n",
        line, F.lit("CARDIOVASCULAR RISK ASSESSMENT REPORT"), line,
        F.concat(F.lit("Generated: "), ts), F.lit(""),
        F.lit("PATIENT INFORMATION"),
        F.concat(F.lit("Age: "), F.col("age").cast("string"), F.lit(" | Gender: "), gender_txt),
        F.concat(F.lit("Height: "), F.col("height").cast("string"), F.lit(" cm | Weight: "),
                 F.col("weight").cast("string"), F.lit(" kg")),
        F.concat(F.lit("Blood Pressure: "), F.col("ap_hi").cast("string"), F.lit("/"),
                 F.col("ap_lo").cast("string"), F.lit(" mmHg")),
        F.lit(""), F.lit("RISK ASSESSMENT"),
        F.concat(F.lit("Risk Score: "), (F.col("probability") * 100).cast("int").cast("string"), F.lit("%")),
        F.concat(F.lit("Classification: "), F.col("risk_level")),
        F.lit(""), F.lit("KEY RISK CONTRIBUTORS"),
        F.array_join(contrib, "\n"),
        F.lit(""), F.lit("RECOMMENDATIONS"), F.lit("High Priority:"), F.array_join(high, "\n"),
        F.lit("Medium Priority:"), F.array_join(med, "\n"),
        F.lit(""), line, F.lit("DISCLAIMER"),
        F.lit("This assessment is for educational purposes only."),
        F.lit("It is not a substitute for professional medical advice."),
        F.lit("Risk categories aligned with standard cardiovascular"),
        F.lit("prevention guidelines (educational use only)."),
        line,
    )
    return x.select("request_id", body.alias("report"))


def report_highlights(assessed: DataFrame, k_contrib: int = 5, k_recs: int = 3,
                      cut: int = 65) -> DataFrame:
    """First k contributors, first k per recommendation list, texts cut at ``cut`` chars."""
    def trim(arr):
        return F.transform(rules.top_k(arr, k_recs), lambda r_: F.struct(
            rules.cut_text(r_["text"], cut).alias("text"), r_["target"].alias("target")))
    return assessed.select(
        "request_id",
        rules.top_k("contributors", k_contrib).alias("top_contributors"),
        trim("action_plan.high").alias("top_high"),
        trim("action_plan.medium").alias("top_medium"),
    )
