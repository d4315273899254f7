"""Per-patient scoring rules with hand-worked expectations."""

import pytest
from pyspark.sql import functions as F

from vitalframe.functions import rules as R
from vitalframe.operators.score import what_if_transform


def _one(spark, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(
        f"{n} {'double' if isinstance(cols[n], float) else 'long'}" for n in names))


def _conf(p):
    """The confidence rule in plain Python floats (edges such as 0.3 / 0.7 included)."""
    s = abs(p - 0.5) * 2
    return "Very High" if s > 0.8 else "High" if s > 0.6 else "Moderate" if s > 0.4 else "Low"


@pytest.mark.parametrize("p,level", [
    (0.05, "Low"), (0.15, "Low"), (0.29, "Low"), (0.3, "Moderate"), (0.5, "High"),
    (0.69, "High"), (0.7, "Very High"), (0.95, "Very High"),
])
def test_risk_level_and_confidence(spark, p, level):
    conf = _conf(p)
    r = _one(spark, probability=p).select(R.risk_level().alias("l"), R.risk_level(suffix=" Risk").alias("s"),
                                          R.confidence_band().alias("c")).first()
    assert (r.l, r.s, r.c) == (level, level + " Risk", conf)


def test_contributors_sorted_by_severity_stable(spark):
    df = _one(spark, bmi_raw=31.7, bp_category=2, cholesterol=3, gluc=2, smoke=1, alco=1, active=0, age=60)
    got = [(c.severity, c.factor, c.description) for c in df.select(R.risk_contributors().alias("x")).first().x]
    assert got == [
        ("HIGH", "Cholesterol", "Very high levels"),
        ("HIGH", "BMI", "Obese (31)"),
        ("HIGH", "Smoking", "Active smoker"),
        ("MEDIUM", "Age", "60 years"),
        ("MEDIUM", "Blood Pressure", "High blood pressure (Stage 1)"),
        ("MEDIUM", "Glucose", "Above normal"),
        ("MEDIUM", "Alcohol", "Regular consumption"),
        ("LOW", "Physical Activity", "Sedentary lifestyle"),
    ]


def test_no_contributors_and_filler_recommendations(spark):
    df = _one(spark, bmi_raw=22.0, bp_category=1, cholesterol=1, gluc=1, smoke=0, alco=0, active=1, age=40)
    r = df.select(R.risk_contributors().alias("c"), R.recommendations().alias("p")).first()
    assert r.c == []
    assert [x.text for x in r.p.high] == ["Continue current healthy practices"]
    assert [x.text for x in r.p.medium] == ["Focus on balanced nutrition"]
    assert r.p.long_term[0].text == "Maintain current activity, consider adding variety"


def test_weight_targets(spark):
    df = _one(spark, bmi_raw=27.9, bp_category=0, cholesterol=1, gluc=1, smoke=0, alco=0, active=1, age=40)
    r = df.select(R.recommendations().alias("p"), R.recommendations_v1().alias("q")).first()
    assert r.p.medium[0].target == "Target: -5 kg in 3 months"        # max(3, int(3.9 * 1.5))
    assert r.q.medium[0] == "Target weight reduction of 7 kg through diet and exercise"  # max(5, int(7.8))


@pytest.mark.parametrize("age,p,want", [(35, 0.9, 95), (45, 0.2, 30), (55, 0.955, 99), (65, 0.1, 50),
                                         (30, 0.0, 15), (65, 0.003, 50)])
def test_age_percentile(spark, age, p, want):
    assert _one(spark, age=age, probability=p).select(R.age_percentile()).first()[0] == want


def test_age_comparison_sentences(spark):
    df = _one(spark, age=50, age_percentile=30)
    assert df.select(R.age_comparison()).first()[0] == (
        "Your risk profile is lower than approximately 70% of individuals in the 45 to 55 age range.")


def test_what_if_floors(spark):
    df = _one(spark, ap_hi=100, ap_lo=65, smoke=1, active=0)
    out = df.select(*[v.alias(k) for k, v in what_if_transform(
        F.lit(0), F.lit(1), F.lit(15)).items()]).first()
    assert (out.ap_hi, out.ap_lo, out.smoke, out.active) == (90, 60, 0, 1)


def test_heart_health_and_texts(spark):
    df = _one(spark, combined_risk_score=37.5, bp_category=9, cholesterol=2, gluc=3)
    r = df.select(R.heart_health_score().alias("h"), R.bp_text().alias("b"),
                  R.cholesterol_text().alias("c"), R.glucose_text().alias("g")).first()
    assert r.h == 62.5 and r.b == "Unknown BP status."
    assert r.c.startswith("Cholesterol is above normal") and r.g.startswith("Elevated glucose")
    assert df.select(R.heart_health_status(F.lit(62.5))).first()[0] == "Good"


def test_advice_list_order(spark):
    df = _one(spark, bmi=17.0, bp_category=2, cholesterol=1, gluc=2, smoke=0, alco=1, active=0, probability=0.4)
    assert df.select(R.advice_list()).first()[0] == [
        R.ADVICE["bmi_low"], R.ADVICE["bp"], R.ADVICE["gluc"], R.ADVICE["alco"], R.ADVICE["inactive"],
        R.ADVICE["level_moderate"]]


def test_top_k_and_cut(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], "x" * 70)], "a array<string>, t string")
    r = df.select(R.top_k("a", 3).alias("k"), R.cut_text(F.col("t")).alias("c")).first()
    assert r.k == ["a", "b", "c"] and r.c == "x" * 65 + "..."
