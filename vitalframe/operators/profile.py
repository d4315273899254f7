"""Profiling, validation and quality operators.

Every report is a long-form DataFrame. Data-dependent numbers come from one
``agg`` over the wide table (map-side partial aggregation, one tiny final
task) or from per-(column, value) counts; the wide result is unpivoted only
after aggregation, when it is one row. Schema-only checks (names, types)
read the DataFrame's schema and launch no job.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalframe.functions.rounding import half_even
from vitalframe.operators import selection
from vitalframe.schema import (
    CATEGORICAL_DOMAINS,
    DUPLICATE_THRESHOLD,
    MAX_MISSING_PERCENTAGE,
    MIN_UNIQUE_CATEGORICAL,
    RAW_COLUMNS,
    VALID_RANGES,
)


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def present(df: DataFrame, column: str) -> Column:
    """The column with NaN as null: in a floating column NaN is a missing value."""
    kind = df.schema[column].dataType
    floating = isinstance(kind, (T.DoubleType, T.FloatType))
    return F.when(~F.isnan(F.col(column)), F.col(column)) if floating else F.col(column)


def _missing_aggs(df: DataFrame) -> list:
    return [F.count_if(present(df, c).isNull()).alias(f"m__{c}") for c in df.columns]


def _duplicates(df: DataFrame):
    """Extra copies of exact duplicates: count(*) - number of distinct rows.

    Counted through a group-by on all columns (nulls compare equal, as in
    pandas), which pre-aggregates map-side, so hot copy groups stay cheap.
    """
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
        F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("rows"),
    )


# ----------------------------------------------------------------- V1 - V3

def dataset_info(df: DataFrame) -> DataFrame:
    """V1: rows, column count, names, dtypes, duplicates and duplicate percent (one row)."""
    cols = df.columns
    d = _duplicates(df)
    names = F.array(*[F.lit(c) for c in cols])
    dtypes = F.lit(", ".join(f"{f.name}:{_dtype_name(f.dataType)}" for f in df.schema.fields))
    return d.select(
        F.col("rows").alias("n_rows"),
        F.lit(len(cols)).alias("n_columns"),
        names.alias("columns"),
        dtypes.alias("dtypes"),
        F.col("duplicates"),
        F.try_divide(F.col("duplicates") * 100.0, F.col("rows")).alias("duplicate_percentage"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """V2: (column, missing_count, missing_percentage), all columns from one ``agg``."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *_missing_aggs(df))
    long = wide.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m__{c}").alias("missing_count"),
                 F.lit(i).alias("position"))
        for i, c in enumerate(df.columns)])).alias("m"))
    return long.select(
        F.col("m.column").alias("column"),
        F.col("m.position").alias("position"),
        F.col("m.missing_count").cast("bigint").alias("missing_count"),
        F.try_divide(F.col("m.missing_count") * 100.0, F.col("_n")).alias("missing_percentage"),
    )


def duplicate_stats(df: DataFrame) -> DataFrame:
    """V3: duplicate count and percent (first copy kept)."""
    return _duplicates(df).select(
        "duplicates", "rows",
        F.try_divide(F.col("duplicates") * 100.0, F.col("rows")).alias("duplicate_percentage"),
    )


# ----------------------------------------------------------------- V4 - V7

def schema_errors(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """V4-V7: (check, column, message) per problem; an empty result means valid.

    V4 required columns and V5 numeric types are read from the schema; V6
    (all-null columns) needs one ``agg`` of non-null counts.
    """
    spark = _spark(df)
    expected = RAW_COLUMNS if expected is None else expected
    rows = []
    for c in expected:
        if c not in df.columns:
            rows.append(("missing_column", c, f"Missing column: {c}"))
    for f in df.schema.fields:
        if f.name in expected and f.name != "id" and not isinstance(f.dataType, T.NumericType):
            rows.append(("non_numeric", f.name, f"Column {f.name} must be numeric"))
    static = spark.createDataFrame(rows, "check string, column string, message string")
    nonnull = df.agg(*[F.count(present(df, c)).alias(f"n__{c}") for c in df.columns])
    empty = nonnull.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n__{c}").alias("n")) for c in df.columns
    ])).alias("e")).where(F.col("e.n") == 0).select(
        F.lit("empty_column").alias("check"), F.col("e.column").alias("column"),
        F.concat(F.lit("Empty column: "), F.col("e.column")).alias("message"))
    return static.unionByName(empty)


def schema_verdict(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """V7: one row (is_valid, n_errors)."""
    return schema_errors(df, expected).agg(
        (F.count(F.lit(1)) == 0).alias("is_valid"),
        F.count(F.lit(1)).alias("n_errors"))


# ----------------------------------------------------------------- V8 - V11

def categorical_values(df: DataFrame, domains: dict | None = None) -> DataFrame:
    """V10 detail: (column, value, is_valid) for every distinct value, nulls included.

    Distinct values come from a group-by on (column, value), pre-aggregated
    map-side; the domain check is a literal ``isin`` (no join needed).
    """
    domains = CATEGORICAL_DOMAINS if domains is None else domains
    cols = [c for c in domains if c in df.columns]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), present(df, c).cast("double").alias("value"))
        for c in cols])).alias("kv")).select("kv.*")
    valid = None
    for c in cols:
        cond = (F.col("column") == c) & F.col("value").isin(*[float(v) for v in domains[c]])
        valid = cond if valid is None else (valid | cond)
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows")).select(
        "column", "value", F.coalesce(valid, F.lit(False)).alias("is_valid"), "rows")


def categorical_checks(df: DataFrame, domains: dict | None = None,
                       null_is_invalid: bool = True) -> DataFrame:
    """Per categorical column: unique / invalid counts and the pass flag.

    A null counts as an invalid value by default (the reference's set
    difference keeps NaN); ``null_is_invalid=False`` ignores nulls.
    """
    vals = categorical_values(df, domains)
    bad = ~F.col("is_valid") & (F.col("value").isNotNull() | F.lit(null_is_invalid))
    return vals.groupBy("column").agg(
        F.count_if(F.col("value").isNotNull()).alias("n_unique"),
        F.count_if(bad).alias("n_invalid"),
        F.max(F.col("value").isNull()).alias("has_null"),
    ).select("column", "n_unique", "n_invalid", "has_null",
             (F.col("n_invalid") == 0).alias("passed"))


def quality_report(df: DataFrame, domains: dict | None = None,
                   null_is_invalid: bool = True) -> DataFrame:
    """(check, column, value, passed) rows plus the overall quality score.

    V8 passes when the largest missing percent is below 5; V9 when the
    duplicate percent is below 1; V10 per categorical column; V11 is
    passed / (2 + categorical checks) * 100, rounded to 2 places.
    """
    domains = CATEGORICAL_DOMAINS if domains is None else domains
    cats = [c for c in domains if c in df.columns]
    # one read for nulls and domains: categorical columns by value, of the others whether a value is there
    long = df.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), (present(df, c).cast("double") if c in cats else F.when(present(df, c).isNotNull(), F.lit(0.0))).alias("value")) for c in df.columns])).alias("kv")).select("kv.*")
    valid = F.lit(False)
    for c in cats:
        valid = F.when(F.col("column") == c, F.col("value").isin(*[float(v) for v in domains[c]])).otherwise(valid)
    bad = ~F.coalesce(valid, F.lit(False)) & (F.col("value").isNotNull() | F.lit(null_is_invalid))
    per = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows")).groupBy("column").agg(
        F.try_divide(F.sum(F.when(F.col("value").isNull(), F.col("rows")).otherwise(0)) * 100.0, F.sum("rows")).alias("missing"), F.count_if(bad).cast("double").alias("n_invalid"))
    none = F.lit(None).cast("string").alias("column")
    # a row a column: nulls and domains fold into one, so the read is not repeated
    folded = per.agg(F.max("missing").alias("missing"), F.collect_list(F.when(F.col("column").isin(cats), F.struct("column", "n_invalid"))).alias("cats"))
    checked = F.transform("cats", lambda c: F.struct(F.lit("categorical").alias("check"), c["column"].alias("column"), c["n_invalid"].alias("value"), (c["n_invalid"] == 0).alias("passed")))
    missing = F.struct(F.lit("missing_values").alias("check"), none, F.col("missing").alias("value"), (F.col("missing") < MAX_MISSING_PERCENTAGE).alias("passed"))
    read = folded.select(F.explode(F.concat(F.array(missing), checked)).alias("r")).select("r.*")
    dup = duplicate_stats(df).select(
        F.lit("duplicates").alias("check"), none, F.col("duplicate_percentage").alias("value"),
        (F.col("duplicate_percentage") < DUPLICATE_THRESHOLD * 100).alias("passed"))
    checks = read.unionByName(dup)
    n_cat = len([c for c in domains if c in df.columns])
    # The check rows (2 + categorical columns) fold into one row, so each
    # source is computed once; the score is added before exploding back.
    one = checks.agg(
        F.collect_list(F.struct("check", "column", "value", "passed")).alias("rows"),
        half_even(F.sum(F.col("passed").cast("int")) / F.lit(2 + n_cat) * 100, 2).alias("score"))
    score_row = F.struct(F.lit("quality_score").alias("check"),
                         F.lit(None).cast("string").alias("column"),
                         F.col("score").alias("value"),
                         F.lit(None).cast("boolean").alias("passed"))
    return one.select(F.explode(F.concat("rows", F.array(score_row))).alias("r")).select("r.*")


# ----------------------------------------------------------------- V12 - V14

def column_statistics(df: DataFrame, columns: list[str] | None = None, distinct: list[str] | None = None) -> DataFrame:
    """describe() per numeric column plus missing and unique counts.

    The numeric columns are held (spillable) while one aggregate takes counts,
    means and extremes, a second the squares around the means (numerically
    two-pass), and refined histograms the exact 25/50/75% quantiles (linear
    interpolation; ``selection.py``). Columns of few values are told by the first
    histogram; only the others of ``distinct`` (all by default) are grouped by
    value for ``unique_count``, null where not asked for. Values of integer columns
    are told apart, counted and compared as integers: ``unique_count``,
    ``min_whole`` and ``max_whole`` (null for other columns) are exact beyond 2 ** 53.
    """
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    schema = ("column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double, "
              "missing bigint, n bigint, unique_count bigint, min_whole bigint, max_whole bigint")
    slim = df.select(*[present(df, c).alias(f"c{i}") for i, c in enumerate(cols)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        at = {c: F.col(f"c{i}") for i, c in enumerate(cols)}
        value = {c: v.cast("double") for c, v in at.items()}
        first = slim.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in (
            F.count(at[c]).alias(f"n{i}"), F.avg(value[c]).alias(f"m{i}"), F.min(value[c]).alias(f"a{i}"), F.max(value[c]).alias(f"b{i}"),
            F.min(at[c].cast("bigint") if c in whole else F.lit(None).cast("bigint")).alias(f"l{i}"), F.max(at[c].cast("bigint") if c in whole else F.lit(None).cast("bigint")).alias(f"h{i}"))]).first()
        squares = slim.agg(*[F.sum((value[c] - F.lit(first[f"m{i}"])) * (value[c] - F.lit(first[f"m{i}"]))).alias(f"s{i}") for i, c in enumerate(cols)], F.lit(0).alias("_")).first()
        counts = {c: first[f"n{i}"] for i, c in enumerate(cols)}
        extremes = {c: (first[f"a{i}"], first[f"b{i}"]) for i, c in enumerate(cols)}
        quarts, found = selection.quantiles(slim, value, counts, [0.25, 0.5, 0.75], extremes)
        # a histogram tells values apart as doubles
        exact = {c for i, c in enumerate(cols) if c not in whole or max(abs(first[f"l{i}"] or 0), abs(first[f"h{i}"] or 0)) <= 1 << 53}
        unique = {c: 0 if not counts[c] else found.distinct[c] for c in cols if not counts[c] or (c in found.distinct and c in exact)}
        many = [c for c in (cols if distinct is None else distinct) if c not in unique]
        if many:
            kept = F.array(*[F.struct(F.lit(cols.index(c)).alias("i"), value[c].alias("value"), (at[c].cast("bigint") if c in whole else F.lit(None).cast("bigint")).alias("whole")) for c in many])
            long = slim.select(F.explode(kept).alias("kv")).select("kv.*").where("value is not null").distinct()
            unique.update({cols[r["i"]]: r["k"] for r in long.groupBy("i").agg(F.count("*").alias("k")).collect()})
    finally:
        slim.unpersist()
    rows = []
    for i, c in enumerate(cols):
        n, ss = counts[c], squares[f"s{i}"]
        std = math.sqrt(ss / (n - 1)) if n > 1 and ss is not None else None
        rows.append((c, n, first[f"m{i}"], std, *extremes[c][:1], *quarts[c], extremes[c][1], first["n"] - n, first["n"], unique.get(c), first[f"l{i}"], first[f"h{i}"]))
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max", F.col("missing").alias("missing_count"),
                      half_even(F.try_divide(F.col("missing") * 100.0, F.col("n")), 2).alias("missing_percent"), "unique_count", "min_whole", "max_whole")


DISTRIBUTION_COLUMNS = ["cardio", "gender", "cholesterol", "gluc", "smoke", "alco", "active"]


def value_distributions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count) per column, nulls excluded, most frequent first."""
    cols = [c for c in (columns or DISTRIBUTION_COLUMNS) if c in df.columns]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), present(df, c).cast("bigint").alias("value"))
        for c in cols])).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")) \
        .orderBy("column", F.desc("count"), "value")


# ----------------------------------------------------------------- V15 - V16

def raw_expectations(df: DataFrame, expected: list[str] | None = None,
                     min_rows: int = 1000) -> DataFrame:
    """>min_rows rows, 13 columns, expected names, no empty column, >1 distinct per column.

    The distinct rule reports how many columns have a single value or none.
    D4 (at least ``MIN_UNIQUE_CATEGORICAL`` distinct values per categorical)
    is one more expectation.
    """
    expected = RAW_COLUMNS if expected is None else expected
    cols = df.columns
    # a column has more than one value if its least and greatest differ
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count(present(df, c)).alias(f"n__{c}") for c in cols],
                  *[F.coalesce((F.min(present(df, c)) == F.max(present(df, c))), F.lit(True)).cast("int").alias(f"d__{c}") for c in cols])
    min_nonnull = F.least(*[F.col(f"n__{c}") for c in cols]) if len(cols) > 1 else F.col(f"n__{cols[0]}")
    constant = sum((F.col(f"d__{c}") for c in cols), F.lit(0))
    cat = [c for c in CATEGORICAL_DOMAINS if c in cols]
    missing_names = sorted(set(expected) - set(cols))
    rows = F.array(
        F.struct(F.lit("row_count_gt_min").alias("expectation"),
                 F.col("_n").cast("double").alias("observed"),
                 (F.col("_n") > min_rows).alias("passed")),
        F.struct(F.lit("column_count").alias("expectation"),
                 F.lit(float(len(cols))).alias("observed"),
                 F.lit(len(cols) == len(expected)).alias("passed")),
        F.struct(F.lit("expected_names_present").alias("expectation"),
                 F.lit(float(len(missing_names))).alias("observed"),
                 F.lit(not missing_names).alias("passed")),
        F.struct(F.lit("no_empty_column").alias("expectation"),
                 min_nonnull.cast("double").alias("observed"),
                 (min_nonnull > 0).alias("passed")),
        F.struct(F.lit("more_than_one_distinct_per_column").alias("expectation"),
                 constant.cast("double").alias("observed"),
                 (constant == 0).alias("passed")),
    )
    out = wide.select(F.explode(rows).alias("e")).select("e.*")
    if not cat:
        return out
    # distinct values of the categoricals from their value counts; one without any value counts as 0
    least = categorical_values(df, {c: [] for c in cat}).where("value is not null").groupBy("column").agg(
        F.count(F.lit(1)).alias("_d")).agg(F.when(F.count(F.lit(1)) == len(cat), F.min("_d")).otherwise(0).alias("_d"))
    return out.unionByName(least.select(
        F.lit("min_unique_categorical").alias("expectation"), F.col("_d").cast("double").alias("observed"),
        (F.col("_d") >= MIN_UNIQUE_CATEGORICAL).alias("passed")))


def cleaned_expectations(df: DataFrame) -> DataFrame:
    """No null, no duplicate, columns, ranges, ap_hi > ap_lo, domains, age 30..80."""
    cols = df.columns
    any_null = F.count_if(F.greatest(*[present(df, c).isNull() for c in cols]))
    range_bad = {c: F.count_if(~F.coalesce(F.col(c).between(*VALID_RANGES[c]), F.lit(False)))
                 for c in ("height", "weight", "ap_hi", "ap_lo") if c in cols}
    dom_bad = {c: F.count_if(~F.coalesce(F.col(c).isin(*v), F.lit(False)))
               for c, v in CATEGORICAL_DOMAINS.items() if c in cols}
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"), any_null.alias("_null_rows"),
        F.count_if(~F.coalesce(F.col("ap_hi") > F.col("ap_lo"), F.lit(False))).alias("_bp_bad"),
        F.count_if(~F.coalesce(F.col("age_years").between(30, 80), F.lit(False))).alias("_age_bad")
        if "age_years" in cols else F.lit(None).alias("_age_bad"),
        *[v.alias(f"_r_{c}") for c, v in range_bad.items()],
        *[v.alias(f"_d_{c}") for c, v in dom_bad.items()],
    )
    required = RAW_COLUMNS + ["age_years"]
    missing = [c for c in required if c not in cols]
    items = [
        ("no_nulls", F.col("_null_rows")),
        ("ap_hi_gt_ap_lo", F.col("_bp_bad")),
        ("age_years_30_80", F.col("_age_bad")),
        ("required_columns", F.lit(len(missing))),
    ] + [(f"range_{c}", F.col(f"_r_{c}")) for c in range_bad] + \
        [(f"domain_{c}", F.col(f"_d_{c}")) for c in dom_bad]
    arr = F.array(*[F.struct(F.lit(n).alias("expectation"),
                             v.cast("bigint").alias("violations"),
                             (v == 0).alias("passed")) for n, v in items])
    checks = wide.select(F.explode(arr).alias("e")).select("e.*")
    dups = _duplicates(df).select(
        F.lit("no_duplicates").alias("expectation"),
        F.col("duplicates").cast("bigint").alias("violations"),
        (F.col("duplicates") == 0).alias("passed"))
    return checks.unionByName(dups)


def string_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """V12 for text columns: count, unique, top (most frequent value), freq and
    missing count. Ties for ``top`` go to the smallest value.

    Built from one count per distinct (column, value), pre-aggregated
    map-side; ``min_by`` over the key (-count, value) picks the top value.
    """
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols
    ])).alias("kv")).select("kv.*")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_cnt"))
    present = counts.where(F.col("value").isNotNull())
    stats = present.groupBy("column").agg(
        F.sum("_cnt").cast("bigint").alias("count"),
        F.count(F.lit(1)).cast("bigint").alias("unique"),
        F.min_by("value", F.struct(F.negative(F.col("_cnt")), F.col("value"))).alias("top"),
        F.max("_cnt").cast("bigint").alias("freq"))
    missing = counts.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("_cnt")).otherwise(0)).cast("bigint")
        .alias("missing_count"))
    return missing.join(stats, "column", "left").select(
        "column", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        F.coalesce("unique", F.lit(0).cast("bigint")).alias("unique"), "top", "freq",
        "missing_count")
