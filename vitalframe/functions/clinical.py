"""Clinical feature expressions (F1-F18) as JVM-side Column builders.

All rules are ``when`` chains and arithmetic, so they stay inside whole-stage
codegen. Operand order follows the reference exactly (it changes the last
floating-point bit, which changes half-even rounding).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalframe.functions.rounding import half_even


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_years(age_days="age") -> Column:
    """round(age / 365.25), half-even, as bigint (null stays null)."""
    return F.rint(col(age_days) / F.lit(365.25)).cast("bigint")


def bmi(weight="weight", height="height") -> Column:
    """weight / (height/100)^2, 2 decimals."""
    m = col(height) / 100
    return half_even(col(weight) / (m * m), 2)


def bmi_category(bmi_col="bmi") -> Column:
    """F2: <18.5 -> 0, <25 -> 1, <30 -> 2, else 3."""
    b = col(bmi_col)
    return (F.when(b < 18.5, 0).when(b < 25, 1).when(b < 30, 2).otherwise(3)).cast("int")


def bsa(height="height", weight="weight") -> Column:
    """sqrt(height * weight / 3600), 2 decimals."""
    return half_even(F.sqrt(col(height) * col(weight) / 3600), 2)


def weight_height_ratio(weight="weight", height="height") -> Column:
    """weight / height * 100, 2 decimals."""
    return half_even(col(weight) / col(height) * 100, 2)


def pulse_pressure(ap_hi="ap_hi", ap_lo="ap_lo") -> Column:
    """F5."""
    return (col(ap_hi) - col(ap_lo)).cast("bigint")


def mean_arterial_pressure(ap_lo="ap_lo", pp="pulse_pressure") -> Column:
    """ap_lo + pulse_pressure / 3, 1 decimal."""
    return half_even(col(ap_lo) + col(pp) / 3, 1)


def bp_category_train(s="ap_hi", d="ap_lo") -> Column:
    """training profile. Class 4 needs s >= 180 and d >= 120 (``or`` rules)."""
    s, d = col(s), col(d)
    return (
        F.when((s < 120) & (d < 80), 0)
        .when((s < 130) & (d < 80), 1)
        .when((s < 140) | (d < 90), 2)
        .when((s < 180) | (d < 120), 3)
        .otherwise(4)
    ).cast("int")


def bp_category_serve(s="ap_hi", d="ap_lo") -> Column:
    """F8: serving profile (inclusive normal band, ``and`` rules)."""
    s, d = col(s), col(d)
    return (
        F.when((s <= 120) & (d <= 80), 0)
        .when((s < 140) & (d < 90), 1)
        .when((s < 160) & (d < 100), 2)
        .when((s < 180) & (d < 120), 3)
        .otherwise(4)
    ).cast("int")


def bp_category(profile: str = "train", s="ap_hi", d="ap_lo") -> Column:
    if profile == "train":
        return bp_category_train(s, d)
    if profile == "serve":
        return bp_category_serve(s, d)
    raise ValueError(f"unknown BP profile: {profile!r} (use 'train' or 'serve')")


def bp_ratio(ap_hi="ap_hi", ap_lo="ap_lo") -> Column:
    """ap_hi / ap_lo, 2 decimals; a zero divisor gives null, not an error."""
    return half_even(F.try_divide(col(ap_hi).cast("double"), col(ap_lo)), 2)


def age_group(age="age_years") -> Column:
    """<40 -> 0, <50 -> 1, <60 -> 2, else 3."""
    a = col(age)
    return (F.when(a < 40, 0).when(a < 50, 1).when(a < 60, 2).otherwise(3)).cast("int")


def age_squared(age="age_years") -> Column:
    """F11."""
    return (col(age) * col(age)).cast("bigint")


def lifestyle_risk_score(smoke="smoke", alco="alco", active="active") -> Column:
    """smoke + alco + (1 - active)."""
    return (col(smoke) + col(alco) + (1 - col(active))).cast("bigint")


def metabolic_risk_score(chol="cholesterol", gluc="gluc") -> Column:
    """F13."""
    return (col(chol) + col(gluc)).cast("bigint")


def combined_risk_score(bp="bp_category", bmi_cat="bmi_category",
                        lifestyle="lifestyle_risk_score",
                        metabolic="metabolic_risk_score") -> Column:
    """bp/4*30 + bmi_cat/3*20 + lifestyle/3*25 + metabolic/6*25, 1 decimal."""
    return half_even(
        col(bp) / 4 * 30 + col(bmi_cat) / 3 * 20
        + col(lifestyle) / 3 * 25 + col(metabolic) / 6 * 25,
        1,
    )


def age_adjusted_risk(combined="combined_risk_score", age="age_years") -> Column:
    """combined * (1 + (age - 30) / 100), 1 decimal."""
    return half_even(col(combined) * (1 + (col(age) - 30) / 100), 1)


def age_bmi_interaction(age="age_years", bmi_col="bmi") -> Column:
    """F16."""
    return half_even(col(age) * col(bmi_col), 2)


def age_bp_interaction(age="age_years", map_col="mean_arterial_pressure") -> Column:
    """F17."""
    return half_even(col(age) * col(map_col), 2)


def gender_bmi_interaction(gender="gender", bmi_cat="bmi_category") -> Column:
    """F18a."""
    return (col(gender) * col(bmi_cat)).cast("bigint")


def smoke_chol_interaction(smoke="smoke", chol="cholesterol") -> Column:
    """F18b."""
    return (col(smoke) * col(chol)).cast("bigint")


def gender_code(g="gender") -> Column:
    """C14: lower/trim; 'male' or 'm' -> 2, anything else -> 1."""
    t = F.lower(F.trim(col(g)))
    return F.when(t.isin("male", "m"), 2).otherwise(1).cast("bigint")
