"""Cleaning operators.

Each operator is ``DataFrame -> DataFrame``; ``clean`` chains them in the
reference order C1 -> C7. Spark is free to reorder: every rule is a
deterministic row filter, so Catalyst pushes them below the de-duplication
aggregate and the aggregate shuffles only surviving rows. De-duplication is a
hash aggregate with map-side partial aggregation, so a hot group of copies
(even a third of all rows) collapses to one row per map task before the
shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.functions import clinical as fx
from vitalframe.schema import (
    CATEGORICAL_DOMAINS,
    CLEAN_INT_COLUMNS,
    RANGE_RULES,
    REQUEST_BOUNDS,
    VALID_RANGES,
)


# ---------------------------------------------------------------- predicates

def categorical_ok(c: str, valid=None) -> Column:
    """True only for a non-null value inside the domain (null fails, as ``isin``)."""
    valid = CATEGORICAL_DOMAINS[c] if valid is None else valid
    return F.coalesce(F.col(c).isin(*valid), F.lit(False))


def range_ok(c: str, key: str | None = None) -> Column:
    lo, hi = VALID_RANGES[key or c]
    return F.coalesce(F.col(c).between(lo, hi), F.lit(False))


def bp_order_ok() -> Column:
    return F.coalesce(F.col("ap_lo") < F.col("ap_hi"), F.lit(False))


def _all(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


# ---------------------------------------------------------------- operators

def remove_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows over all columns; one copy kept."""
    return df.dropDuplicates()


def convert_age_to_years(df: DataFrame) -> DataFrame:
    """Adds ``age_years`` = half-even round of age / 365.25."""
    return df.withColumn("age_years", fx.age_years("age"))


def filter_categorical(df: DataFrame, domains: dict | None = None) -> DataFrame:
    """Keep rows whose categorical columns are in their domains (absent columns skipped)."""
    domains = CATEGORICAL_DOMAINS if domains is None else domains
    # a filter drops a null predicate by itself: no coalesce, smaller generated code
    preds = [F.col(c).isin(*v) for c, v in domains.items() if c in df.columns]
    return df.where(_all(preds))


def filter_ranges(df: DataFrame, rules=None, extra_rules: tuple[str, ...] = ()) -> DataFrame:
    """C4: inclusive range rules; ``extra_rules`` may add 'age_days' or 'bmi' (D5)."""
    rules = RANGE_RULES if rules is None else rules
    preds = [F.col(c).between(*VALID_RANGES[key]) for c, key, _ in rules if c in df.columns]
    if "age_days" in extra_rules and "age" in df.columns:
        preds.append(F.col("age").between(*VALID_RANGES["age_days"]))
    if "bmi" in extra_rules and "bmi" in df.columns:
        preds.append(F.col("bmi").between(*VALID_RANGES["bmi"]))
    return df.where(_all(preds))


def filter_bp_anomalies(df: DataFrame) -> DataFrame:
    """Keep ``ap_lo < ap_hi``."""
    if "ap_hi" in df.columns and "ap_lo" in df.columns:
        return df.where(F.col("ap_lo") < F.col("ap_hi"))
    return df


def drop_missing(df: DataFrame) -> DataFrame:
    """Drop rows with a null in any column."""
    return df.na.drop(how="any")


def cast_types(df: DataFrame) -> DataFrame:
    """Integer columns to bigint (truncating), weight to double."""
    out = []
    for c in df.columns:
        if c in CLEAN_INT_COLUMNS:
            out.append(F.col(c).cast("bigint").alias(c))
        elif c == "weight":
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def clean(df: DataFrame) -> DataFrame:
    """Full cleaning pipeline C1 -> C7."""
    return (
        df.transform(remove_duplicates)
        .transform(convert_age_to_years)
        .transform(filter_categorical)
        .transform(filter_ranges)
        .transform(filter_bp_anomalies)
        .transform(drop_missing)
        .transform(cast_types)
    )


# ---------------------------------------------------------------- C8 report

def rejection_reason(columns: list[str]) -> Column:
    """First failing rule of a (de-duplicated) row, or null when it survives.

    Order: categorical columns in config order, range rules in list order,
    BP anomaly, then any remaining null.
    """
    whens = []
    for c in CATEGORICAL_DOMAINS:
        if c in columns:
            whens.append(F.when(~categorical_ok(c), F.lit(f"invalid_categorical:{c}")))
    for c, key, report in RANGE_RULES:
        if c in columns:
            whens.append(F.when(~range_ok(c, key), F.lit(f"outlier:{report}")))
    if "ap_hi" in columns and "ap_lo" in columns:
        whens.append(F.when(~bp_order_ok(), F.lit("outlier:bp_anomalies")))
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    whens.append(F.when(any_null, F.lit("missing:any")))
    return F.coalesce(*whens)


def rejection_report(raw: DataFrame) -> DataFrame:
    """One pass over the raw table -> long-form cleaning report.

    Rows: (step, rule, rows). Exact copies are counted once per distinct row
    with ``count - 1`` charged to ``duplicates``; each distinct row is then
    charged to the first rule it fails. Per-rule rows appear only when the
    count is positive, as in the reference report.
    """
    return report_from_tagged(tag_distinct_rows(raw))


def tag_distinct_rows(raw: DataFrame) -> DataFrame:
    """Distinct raw rows + ``age_years`` + ``_copies`` + first failing rule ``_reason``.

    One all-columns hash aggregate (partial aggregation map-side). Rows with a
    null ``_reason`` are exactly the cleaned table.
    """
    distinct_rows = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_copies"))
    with_age = distinct_rows.withColumn("age_years", fx.age_years("age"))
    cols = raw.columns + ["age_years"]
    return with_age.withColumn("_reason", rejection_reason(cols))


def cleaned_from_tagged(tagged: DataFrame) -> DataFrame:
    """C9 from tagged distinct rows: survivors, original columns + age_years, cast."""
    keep = [c for c in tagged.columns if c not in ("_copies", "_reason")]
    return tagged.where(F.col("_reason").isNull()).select(*keep).transform(cast_types)


def report_from_tagged(tagged: DataFrame) -> DataFrame:
    """C8 report rows from tagged distinct rows."""
    per_reason = tagged.groupBy("_reason").agg(
        F.sum("_copies").alias("_rows"), F.count(F.lit(1)).alias("_distinct"))
    # per_reason has at most (number of rules + 1) rows: fold it into one row
    # (the list is bounded by the rule count) and explode once, so the
    # all-columns shuffle above runs a single time.
    one = per_reason.agg(
        F.sum("_rows").alias("initial"),
        (F.sum("_rows") - F.sum("_distinct")).alias("duplicates"),
        F.sum(F.when(F.col("_reason").isNull(), F.col("_distinct")).otherwise(0)).alias("final"),
        F.collect_list(F.when(F.col("_reason").isNotNull() & (F.col("_distinct") > 0),
                              F.struct(F.col("_reason").alias("reason"),
                                       F.col("_distinct").alias("n")))).alias("rules"),
    )

    def row(step, rule, n):
        return F.struct(F.lit(step).alias("step"), F.lit(rule).alias("rule"),
                        n.cast("bigint").alias("rows"))

    summary = F.array(
        row("initial_shape", "rows", F.col("initial")),
        row("duplicates_removed", "all_columns", F.col("duplicates")),
        row("final_shape", "rows", F.col("final")),
        row("removed_rows", "rows", F.col("initial") - F.col("final")),
    )
    rules = F.transform("rules", lambda r: F.struct(
        F.split(r["reason"], ":").getItem(0).alias("step"),
        F.split(r["reason"], ":").getItem(1).alias("rule"),
        r["n"].cast("bigint").alias("rows")))
    return one.select(F.explode(F.concat(summary, rules)).alias("r")).select("r.*")


# ---------------------------------------------------------------- requests

def request_violation(columns: list[str] | None = None) -> Column:
    """C11: first violated bound of a score request, or null when valid; a line that did not parse comes first."""
    whens = []
    if columns is not None and "malformed" in columns:
        whens.append(F.when(F.col("malformed").isNotNull(), F.lit("malformed")))
    if columns is None or "gender" in columns:
        whens.append(F.when(F.col("gender").isNull(), F.lit("missing:gender")))
    for c, (lo, hi) in REQUEST_BOUNDS.items():
        whens.append(F.when(F.col(c).isNull(), F.lit(f"missing:{c}")))
        whens.append(F.when(~F.col(c).between(lo, hi), F.lit(f"out_of_bounds:{c}")))
    return F.coalesce(*whens)


def validate_requests(requests: DataFrame) -> DataFrame:
    """C11: adds ``rejection`` (null when the request is valid)."""
    return requests.withColumn("rejection", request_violation(requests.columns))


def hypotension(ap_hi="ap_hi", ap_lo="ap_lo") -> Column:
    """BP below the range the model was trained on."""
    return (F.col(ap_hi) < 90) | (F.col(ap_lo) < 60)


# Form label -> code maps of the web form.
CHOLESTEROL_LABELS = {
    "Normal (< 200 mg/dL)": 1,
    "Above Normal (200-239 mg/dL)": 2,
    "High (>= 240 mg/dL)": 3,
}
GLUCOSE_LABELS = {
    "Normal (< 100 mg/dL)": 1,
    "Above Normal (100-125 mg/dL)": 2,
    "High (>= 126 mg/dL)": 3,
}


def label_code(c: str, mapping: dict[str, int]) -> Column:
    """Text label -> code through a literal map (null when unknown)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[F.col(c)].cast("bigint")


def yes_no_code(c: str) -> Column:
    """C13: 'Yes' -> 1, anything else -> 0."""
    return F.when(F.col(c) == "Yes", 1).otherwise(0).cast("bigint")
