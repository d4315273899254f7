"""DuckDB oracle SQL for the correctness gate.

Each query here is an independent SQL statement of what the matching
Spark query computes, written against the pre-registered parquet views.
Portability rules: ``CAST(x AS DOUBLE)`` instead of decimal literals,
``round_even(x * 10^d, 0) / 10^d`` for numpy-style rounding, ``FLOOR``
before casting doubles to BIGINT.
"""

from __future__ import annotations

import oracle_texts as TX


def R(expr: str, d: int) -> str:
    s = 10 ** d
    return f"(round_even(({expr}) * {s}, 0) / {s})"


def R6(expr: str) -> str:
    return R(expr, 6)


DBL = "CAST('{}' AS DOUBLE)".format

PATIENTS = """
patients AS (
 SELECT id,
  CAST(10200 + (h*7919)%16200 AS BIGINT) age,
  CAST(CASE WHEN id%97=0 THEN 3 ELSE 1+(h%2) END AS BIGINT) gender,
  CAST(135 + (h*37)%80 AS BIGINT) height,
  CAST(CASE WHEN id%211=0 THEN NULL ELSE 38+(h*53)%165 END AS DOUBLE) + CAST(h%10 AS DOUBLE)/10 weight,
  CAST(85 + (h*61)%125 AS BIGINT) ap_hi,
  CAST(55 + (h*67)%80 AS BIGINT) ap_lo,
  CAST(1 + (h%3) AS BIGINT) cholesterol,
  CAST(1 + ((h*11)%7)%3 AS BIGINT) gluc,
  CAST(CASE WHEN (h*13)%10 < 2 THEN 1 ELSE 0 END AS BIGINT) smoke,
  CAST(CASE WHEN (h*17)%20 < 1 THEN 1 ELSE 0 END AS BIGINT) alco,
  CAST(CASE WHEN (h*19)%10 < 8 THEN 1 ELSE 0 END AS BIGINT) active,
  CAST(CASE WHEN (h*61)%125 + (h*41)%80 > 100 THEN 1 ELSE 0 END AS BIGINT) cardio
 FROM (SELECT o_orderkey id, o_custkey*7 + CAST(FLOOR(o_totalprice) AS BIGINT)%9973 AS h FROM orders
       UNION ALL
       SELECT o_orderkey id, o_custkey*7 + CAST(FLOOR(o_totalprice) AS BIGINT)%9973 AS h FROM orders WHERE o_orderkey%150=0) t)
"""

RAW_COLS = ["id", "age", "gender", "height", "weight", "ap_hi", "ap_lo",
            "cholesterol", "gluc", "smoke", "alco", "active", "cardio"]
CAT = {"gender": [1, 2], "cholesterol": [1, 2, 3], "gluc": [1, 2, 3], "smoke": [0, 1],
       "alco": [0, 1], "active": [0, 1], "cardio": [0, 1]}
RANGES = [("age_years", 30, 70, "age"), ("height", 140, 210, "height"),
          ("weight", 40, 200, "weight"), ("ap_hi", 90, 200, "systolic_bp"),
          ("ap_lo", 60, 130, "diastolic_bp")]

AGE_YEARS = "CAST(round_even(CAST(age AS DOUBLE) / CAST(365.25 AS DOUBLE), 0) AS BIGINT)"


def _cat_ok(c):
    return f"coalesce({c} IN ({', '.join(map(str, CAT[c]))}), false)"


def _range_ok(c, lo, hi):
    return f"coalesce({c} BETWEEN {lo} AND {hi}, false)"


_CLEAN_WHERE = " AND ".join(
    [_cat_ok(c) for c in CAT]
    + [_range_ok(c, lo, hi) for c, lo, hi, _ in RANGES]
    + ["coalesce(ap_lo < ap_hi, false)"]
    + [f"{c} IS NOT NULL" for c in RAW_COLS + ["age_years"]]
)

CLEAN = f"""
dedup AS (SELECT DISTINCT * FROM patients),
aged AS (SELECT *, {AGE_YEARS} AS age_years FROM dedup),
clean AS (SELECT {', '.join(RAW_COLS)}, age_years FROM aged WHERE {_CLEAN_WHERE})
"""

BP_TRAIN = ("CAST(CASE WHEN ap_hi < 120 AND ap_lo < 80 THEN 0 WHEN ap_hi < 130 AND ap_lo < 80 THEN 1 "
            "WHEN ap_hi < 140 OR ap_lo < 90 THEN 2 WHEN ap_hi < 180 OR ap_lo < 120 THEN 3 ELSE 4 END AS INTEGER)")
BP_SERVE = ("CAST(CASE WHEN ap_hi <= 120 AND ap_lo <= 80 THEN 0 WHEN ap_hi < 140 AND ap_lo < 90 THEN 1 "
            "WHEN ap_hi < 160 AND ap_lo < 100 THEN 2 WHEN ap_hi < 180 AND ap_lo < 120 THEN 3 ELSE 4 END AS INTEGER)")
BMI_CAT = "CAST(CASE WHEN bmi < 18.5 THEN 0 WHEN bmi < 25 THEN 1 WHEN bmi < 30 THEN 2 ELSE 3 END AS INTEGER)"
AGE_GROUP = ("CAST(CASE WHEN age_years < 40 THEN 0 WHEN age_years < 50 THEN 1 "
             "WHEN age_years < 60 THEN 2 ELSE 3 END AS INTEGER)")
COMBINED = R("bp_category / 4 * 30 + bmi_category / 3 * 20 + lifestyle_risk_score / 3 * 25 "
             "+ metabolic_risk_score / 6 * 25", 1)


def features_cte(src: str = "clean", name: str = "featured", bp: str = BP_TRAIN) -> str:
    return f"""
{name}_1 AS (SELECT *, {R('weight / ((height / 100) * (height / 100))', 2)} AS bmi FROM {src}),
{name}_2 AS (SELECT *, {BMI_CAT} AS bmi_category,
   {R('sqrt(height * weight / 3600)', 2)} AS bsa,
   {R('weight / height * 100', 2)} AS weight_height_ratio,
   CAST(ap_hi - ap_lo AS BIGINT) AS pulse_pressure FROM {name}_1),
{name}_3 AS (SELECT *, {R('ap_lo + pulse_pressure / 3', 1)} AS mean_arterial_pressure,
   {bp} AS bp_category,
   {R('CAST(ap_hi AS DOUBLE) / ap_lo', 2)} AS bp_ratio,
   {AGE_GROUP} AS age_group,
   CAST(age_years * age_years AS BIGINT) AS age_squared,
   CAST(smoke + alco + (1 - active) AS BIGINT) AS lifestyle_risk_score,
   CAST(cholesterol + gluc AS BIGINT) AS metabolic_risk_score FROM {name}_2),
{name}_4 AS (SELECT *, {COMBINED} AS combined_risk_score FROM {name}_3),
{name} AS (SELECT *, {R('combined_risk_score * (1 + (age_years - 30) / 100)', 1)} AS age_adjusted_risk,
   {R('age_years * bmi', 2)} AS age_bmi_interaction,
   {R('age_years * mean_arterial_pressure', 2)} AS age_bp_interaction,
   CAST(gender * bmi_category AS BIGINT) AS gender_bmi_interaction,
   CAST(smoke * cholesterol AS BIGINT) AS smoke_chol_interaction FROM {name}_4)
"""


FEATURED = features_cte()


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


BASE = with_(PATIENTS, CLEAN, FEATURED)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["flagship_bp_category"] = BASE + f"""
SELECT bp_category, COUNT(*) AS patients, {R6('AVG(CAST(cardio AS DOUBLE))')} AS cardio_rate,
       {R6('AVG(age_years)')} AS mean_age
FROM featured GROUP BY bp_category"""
    q["C9_clean"] = with_(PATIENTS, CLEAN) + "SELECT * FROM clean"
    q["F19_features"] = BASE + "SELECT * FROM featured"
    q.update(profile_queries())
    q.update(clean_report_queries())
    q.update(split_queries())
    q.update(eval_queries())
    q.update(scoring_queries())
    q.update(option_queries())
    q.update(cleaning_step_queries())
    q.update(label_table_queries())
    q.update(fixed_model_queries())
    q.update(single_operator_queries())
    q["V12_string_statistics"] = with_(PATIENTS, *_requests_ctes()[:1]) + """
SELECT 'gender' AS "column", CAST(COUNT(gender) AS BIGINT) AS "count",
 CAST(COUNT(DISTINCT gender) AS BIGINT) AS "unique",
 (SELECT gender FROM req WHERE gender IS NOT NULL GROUP BY gender ORDER BY COUNT(*) DESC, gender LIMIT 1) AS top,
 (SELECT CAST(COUNT(*) AS BIGINT) FROM req WHERE gender IS NOT NULL GROUP BY gender ORDER BY COUNT(*) DESC LIMIT 1) AS freq,
 CAST(COUNT(*) - COUNT(gender) AS BIGINT) AS missing_count FROM req"""
    return q


# ---------------------------------------------------------------- profiling

def _dbl(c):
    return f"CAST({c} AS DOUBLE)"


def _dups_cte(src):
    cols = ", ".join(RAW_COLS) if src == "patients" else ", ".join(RAW_COLS + ["age_years"])
    return f"g AS (SELECT COUNT(*) AS c FROM {src} GROUP BY {cols})"


DTYPES_RAW = ", ".join(f"{c}:{'double' if c == 'weight' else 'bigint'}" for c in RAW_COLS)
CLEAN_COLS = RAW_COLS + ["age_years"]
DIST_COLS = ["cardio", "gender", "cholesterol", "gluc", "smoke", "alco", "active"]


def _col_stats(src, cols):
    parts = []
    for c in cols:
        x = _dbl(c)
        parts.append(f"""SELECT '{c}' AS "column", CAST(COUNT({c}) AS BIGINT) AS "count",
 {R6(f'AVG({x})')} AS mean, {R6(f'STDDEV_SAMP({x})')} AS std, {R6(f'MIN({x})')} AS "min",
 {R6(f'quantile_cont({x}, 0.25)')} AS p25, {R6(f'quantile_cont({x}, 0.5)')} AS p50,
 {R6(f'quantile_cont({x}, 0.75)')} AS p75, {R6(f'MAX({x})')} AS "max",
 CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing_count,
 {R(f'CAST(COUNT(*) - COUNT({c}) AS DOUBLE) * 100 / COUNT(*)', 2)} AS missing_percent,
 CAST(COUNT(DISTINCT {c}) AS BIGINT) AS unique_count,
 {'CAST(NULL AS BIGINT)' if c == 'weight' else f'CAST(MIN({c}) AS BIGINT)'} AS min_whole,
 {'CAST(NULL AS BIGINT)' if c == 'weight' else f'CAST(MAX({c}) AS BIGINT)'} AS max_whole FROM {src}""")
    return "\nUNION ALL\n".join(parts)


def _cat_long(src):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", {_dbl(c)} AS value FROM {src}" for c in CAT)


def _cat_values_cte():
    valid = " OR ".join(
        f"(\"column\" = '{c}' AND value IN ({', '.join(map(str, v))}))" for c, v in CAT.items())
    return f"""catlong AS ({_cat_long('patients')}),
catvals AS (SELECT "column", value, coalesce({valid}, false) AS is_valid, COUNT(*) AS "rows"
            FROM catlong GROUP BY "column", value),
catchecks AS (SELECT "column", COUNT(*) FILTER (WHERE value IS NOT NULL) AS n_unique,
   COUNT(*) FILTER (WHERE NOT is_valid) AS n_invalid, bool_or(value IS NULL) AS has_null
   FROM catvals GROUP BY "column")"""


def _missing_cte(src, cols):
    parts = [f"""SELECT '{c}' AS "column", {i} AS position,
 CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing_count,
 CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100 / COUNT(*) AS missing_percentage
 FROM {src}""" for i, c in enumerate(cols)]
    return "missing AS (" + "\nUNION ALL\n".join(parts) + ")"


def profile_queries() -> dict[str, str]:
    q = {}
    dup_pct = R6("CAST(SUM(c - 1) AS DOUBLE) * 100 / SUM(c)")
    q["V1_dataset_info"] = with_(PATIENTS, _dups_cte("patients")) + f"""
SELECT CAST(SUM(c) AS BIGINT) AS n_rows, 13 AS n_columns,
 [{', '.join(repr(c) for c in RAW_COLS)}] AS "columns", '{DTYPES_RAW}' AS dtypes,
 CAST(SUM(c - 1) AS BIGINT) AS duplicates, {dup_pct} AS duplicate_percentage FROM g"""
    q["V2_missing_values"] = with_(PATIENTS, _missing_cte("patients", RAW_COLS)) + f'SELECT * REPLACE ({R6("missing_percentage")} AS missing_percentage) FROM missing'
    q["V3_duplicates"] = with_(PATIENTS, _dups_cte("patients")) + f"""
SELECT CAST(SUM(c - 1) AS BIGINT) AS duplicates, CAST(SUM(c) AS BIGINT) AS "rows",
 {dup_pct} AS duplicate_percentage FROM g"""
    empty = "\nUNION ALL\n".join(
        f"SELECT 'empty_column' AS \"check\", '{c}' AS \"column\", 'Empty column: {c}' AS message "
        f"FROM patients HAVING COUNT({c}) = 0" for c in RAW_COLS)
    q["V4_V6_schema_errors"] = with_(PATIENTS) + empty
    q["V7_schema_verdict"] = with_(PATIENTS, f"errs AS ({empty})") + \
        "SELECT COUNT(*) = 0 AS is_valid, COUNT(*) AS n_errors FROM errs"
    q["V10_categorical_values"] = with_(PATIENTS, _cat_values_cte()) + "SELECT * FROM catvals"
    q["V10_categorical_checks"] = with_(PATIENTS, _cat_values_cte()) + \
        "SELECT *, n_invalid = 0 AS passed FROM catchecks"
    q["V8_V11_quality_report"] = with_(
        PATIENTS, _cat_values_cte(), _missing_cte("patients", RAW_COLS), _dups_cte("patients"),
        f"""checks AS (
 SELECT 'missing_values' AS "check", CAST(NULL AS VARCHAR) AS "column", {R6('MAX(missing_percentage)')} AS value,
   MAX(missing_percentage) < 5 AS passed FROM missing
 UNION ALL
 SELECT 'duplicates', NULL, {dup_pct}, CAST(SUM(c - 1) AS DOUBLE) * 100 / SUM(c) < 1 FROM g
 UNION ALL
 SELECT 'categorical', "column", CAST(n_invalid AS DOUBLE), n_invalid = 0 FROM catchecks)""") + f"""
SELECT * FROM checks UNION ALL
SELECT 'quality_score', NULL, {R('SUM(CAST(passed AS INTEGER)) / 9 * 100', 2)}, CAST(NULL AS BOOLEAN) FROM checks"""
    q["V12_column_statistics"] = with_(PATIENTS) + _col_stats("patients", RAW_COLS)
    q["V13_clean_describe"] = with_(PATIENTS, CLEAN) + _col_stats("clean", CLEAN_COLS)
    q["V14_value_distributions"] = with_(PATIENTS, CLEAN) + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS BIGINT) AS value, COUNT(*) AS \"count\" "
        f"FROM clean WHERE {c} IS NOT NULL GROUP BY {c}" for c in DIST_COLS)
    least_nn = "LEAST(" + ", ".join(f"COUNT({c})" for c in RAW_COLS) + ")"
    const = " + ".join(f"CAST(coalesce(MIN({c}) = MAX({c}), true) AS INTEGER)" for c in RAW_COLS)
    least_cat = "LEAST(" + ", ".join(f"COUNT(DISTINCT {c})" for c in CAT) + ")"
    q["V15_raw_expectations"] = with_(PATIENTS, f"""w AS (SELECT COUNT(*) AS n, {least_nn} AS nn,
 {const} AS d, {least_cat} AS dc FROM patients)""") + """
SELECT 'row_count_gt_min' AS expectation, CAST(n AS DOUBLE) AS observed, n > 1000 AS passed FROM w
UNION ALL SELECT 'column_count', CAST(13 AS DOUBLE), true FROM w
UNION ALL SELECT 'expected_names_present', CAST(0 AS DOUBLE), true FROM w
UNION ALL SELECT 'no_empty_column', CAST(nn AS DOUBLE), nn > 0 FROM w
UNION ALL SELECT 'more_than_one_distinct_per_column', CAST(d AS DOUBLE), d = 0 FROM w
UNION ALL SELECT 'min_unique_categorical', CAST(dc AS DOUBLE), dc >= 2 FROM w"""
    any_null = " OR ".join(f"{c} IS NULL" for c in CLEAN_COLS)
    items = [("no_nulls", f"COUNT(*) FILTER (WHERE {any_null})"),
             ("ap_hi_gt_ap_lo", "COUNT(*) FILTER (WHERE NOT coalesce(ap_hi > ap_lo, false))"),
             ("age_years_30_80", "COUNT(*) FILTER (WHERE NOT coalesce(age_years BETWEEN 30 AND 80, false))"),
             ("required_columns", "0 * COUNT(*)")]
    for c, lo, hi in [("height", 140, 210), ("weight", 40, 200), ("ap_hi", 90, 200), ("ap_lo", 60, 130)]:
        items.append((f"range_{c}", f"COUNT(*) FILTER (WHERE NOT coalesce({c} BETWEEN {lo} AND {hi}, false))"))
    for c, v in CAT.items():
        items.append((f"domain_{c}", f"COUNT(*) FILTER (WHERE NOT coalesce({c} IN ({', '.join(map(str, v))}), false))"))
    body = "\nUNION ALL\n".join(
        f"SELECT '{n}' AS expectation, CAST({e} AS BIGINT) AS violations, ({e}) = 0 AS passed FROM clean"
        for n, e in items)
    q["V16_cleaned_expectations"] = with_(PATIENTS, CLEAN, _dups_cte("clean")) + body + f"""
UNION ALL SELECT 'no_duplicates', CAST(SUM(c - 1) AS BIGINT), SUM(c - 1) = 0 FROM g"""
    return q


# ---------------------------------------------------------------- C8 report

def clean_report_queries() -> dict[str, str]:
    reasons = [f"WHEN NOT {_cat_ok(c)} THEN 'invalid_categorical:{c}'" for c in CAT]
    reasons += [f"WHEN NOT {_range_ok(c, lo, hi)} THEN 'outlier:{rep}'" for c, lo, hi, rep in RANGES]
    reasons += ["WHEN NOT coalesce(ap_lo < ap_hi, false) THEN 'outlier:bp_anomalies'"]
    any_null = " OR ".join(f"{c} IS NULL" for c in CLEAN_COLS)
    reasons += [f"WHEN {any_null} THEN 'missing:any'"]
    case = "CASE " + " ".join(reasons) + " END"
    cte = f"""d AS (SELECT {', '.join(RAW_COLS)}, COUNT(*) AS copies FROM patients GROUP BY ALL),
t AS (SELECT copies, {case} AS reason FROM (SELECT *, {AGE_YEARS} AS age_years FROM d)),
pr AS (SELECT reason, SUM(copies) AS r, COUNT(*) AS dn FROM t GROUP BY reason),
tot AS (SELECT SUM(r) AS initial, SUM(r) - SUM(dn) AS dups,
        SUM(CASE WHEN reason IS NULL THEN dn ELSE 0 END) AS final FROM pr)"""
    sql = with_(PATIENTS, cte) + """
SELECT 'initial_shape' AS step, 'rows' AS rule, CAST(initial AS BIGINT) AS "rows" FROM tot
UNION ALL SELECT 'duplicates_removed', 'all_columns', CAST(dups AS BIGINT) FROM tot
UNION ALL SELECT 'final_shape', 'rows', CAST(final AS BIGINT) FROM tot
UNION ALL SELECT 'removed_rows', 'rows', CAST(initial - final AS BIGINT) FROM tot
UNION ALL SELECT split_part(reason, ':', 1), split_part(reason, ':', 2), CAST(dn AS BIGINT)
 FROM pr WHERE reason IS NOT NULL AND dn > 0"""
    return {"C8_rejection_report": sql}


# ---------------------------------------------------------------- splits

def D(x: float) -> str:
    """A double literal with the exact value of the Python float."""
    return f"CAST('{x!r}' AS DOUBLE)"


TEST_SIZE, VAL_SIZE = 0.2, 0.15
T_CUT = TEST_SIZE
VAL_RATIO = VAL_SIZE / (1 - TEST_SIZE)
V_CUT = TEST_SIZE + VAL_RATIO * (1 - TEST_SIZE)
HKEY = "CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 8)) AS BIGINT)"
HUNIT = f"({HKEY} / CAST(4294967296 AS DOUBLE))"
SPLIT = (f"CASE WHEN {HUNIT} < {D(T_CUT)} THEN 'test' WHEN {HUNIT} < {D(V_CUT)} "
         "THEN 'validation' ELSE 'train' END")
SPLIT_CTE = f"splitted AS (SELECT *, {SPLIT} AS split FROM featured)"
FEATS20 = ["age_years", "gender", "height", "weight", "ap_hi", "ap_lo", "cholesterol", "gluc",
           "smoke", "alco", "active", "bmi", "bmi_category", "pulse_pressure",
           "mean_arterial_pressure", "bp_category", "age_group", "lifestyle_risk_score",
           "metabolic_risk_score", "combined_risk_score"]


def _cnt(src, *keys):
    k = ", ".join(keys)
    return f"SELECT {k}, COUNT(*) AS \"rows\" FROM {src} GROUP BY {k}"


def split_queries() -> dict[str, str]:
    q = {}
    q["P1_split_counts"] = with_(PATIENTS, CLEAN, FEATURED, SPLIT_CTE) + _cnt("splitted", "split", "cardio")
    ranked = f"""ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cardio ORDER BY {HKEY}, id) - 1 AS rk,
   COUNT(*) OVER (PARTITION BY cardio) AS n FROM featured),
ex AS (SELECT *, round_even(n * {D(TEST_SIZE)}, 0) AS n_test FROM ranked),
ex2 AS (SELECT *, CASE WHEN rk < n_test THEN 'test'
   WHEN rk < n_test + round_even((n - n_test) * {D(VAL_RATIO)}, 0) THEN 'validation' ELSE 'train' END AS split FROM ex)"""
    q["P1_exact_split_counts"] = with_(PATIENTS, CLEAN, FEATURED, ranked) + _cnt("ex2", "split", "cardio")
    q["P2_train_test_counts"] = with_(PATIENTS, CLEAN, FEATURED, f"""tt AS (SELECT *,
   CASE WHEN {HUNIT} < {D(TEST_SIZE)} THEN 'test' ELSE 'train' END AS split FROM featured)""") + \
        _cnt("tt", "split", "cardio")
    q["P3_kfold_counts"] = with_(PATIENTS, CLEAN, FEATURED, f"""kf AS (SELECT *,
   CAST(floor({HUNIT} * 5) AS INTEGER) AS fold FROM featured)""") + _cnt("kf", "fold", "cardio")
    q["P3_kfold_exact_counts"] = with_(PATIENTS, CLEAN, FEATURED, f"""kf AS (SELECT *,
   CAST((ROW_NUMBER() OVER (PARTITION BY cardio ORDER BY {HKEY}, id) - 1) % 5 AS INTEGER) AS fold
   FROM featured)""") + _cnt("kf", "fold", "cardio")
    std_stats = ", ".join(
        f"AVG(CAST({c} AS DOUBLE)) AS m_{c}, coalesce(nullif(STDDEV_POP(CAST({c} AS DOUBLE)), 0), 1) AS s_{c}"
        for c in FEATS20)
    q["P1_split_rows"] = with_(PATIENTS, CLEAN, FEATURED, SPLIT_CTE) + "SELECT id, split FROM splitted"
    q["P1_exact_split_rows"] = with_(PATIENTS, CLEAN, FEATURED, ranked) + "SELECT id, split FROM ex2"
    q["P2_train_test_rows"] = q["P2_train_test_counts"].replace(_cnt("tt", "split", "cardio"), "SELECT id, split FROM tt")
    q["P3_kfold_rows"] = q["P3_kfold_counts"].replace(_cnt("kf", "fold", "cardio"), "SELECT id, fold FROM kf")
    q["P3_kfold_exact_rows"] = q["P3_kfold_exact_counts"].replace(_cnt("kf", "fold", "cardio"), "SELECT id, fold FROM kf")
    holes = "holes AS (SELECT CASE WHEN id % 5 <> 0 THEN cardio END AS cardio FROM patients)"
    # which rows go where depends on ties; the counts per label do not
    q["P1_exact_split_null_keys"] = with_(PATIENTS, holes, f"""n AS (SELECT cardio, COUNT(*) AS n FROM holes GROUP BY cardio),
t AS (SELECT *, CAST(round_even(n * {D(TEST_SIZE)}, 0) AS BIGINT) AS n_test FROM n),
v AS (SELECT *, CAST(round_even((n - n_test) * {D(VAL_RATIO)}, 0) AS BIGINT) AS n_val FROM t)""") + """
SELECT 'test' AS split, cardio, n_test AS "rows" FROM v UNION ALL SELECT 'validation', cardio, n_val FROM v
UNION ALL SELECT 'train', cardio, n - n_test - n_val FROM v"""
    q["P3_kfold_exact_null_keys"] = with_(PATIENTS, holes, "n AS (SELECT cardio, ROW_NUMBER() OVER (PARTITION BY cardio) - 1 AS rk FROM holes)") + \
        "SELECT CAST(rk % 5 AS INTEGER) AS fold, cardio, COUNT(*) AS \"rows\" FROM n GROUP BY ALL"
    q["P4_standard_scaling"] = with_(PATIENTS, CLEAN, FEATURED, SPLIT_CTE,
                                     f"st AS (SELECT {std_stats} FROM splitted WHERE split = 'train')") + \
        "SELECT id, " + ", ".join(f"{R6(f'(CAST({c} AS DOUBLE) - m_{c}) / s_{c}')} AS {c}" for c in FEATS20) + \
        ", cardio FROM splitted, st WHERE split = 'test'"
    mm_stats = ", ".join(
        f"MIN(CAST({c} AS DOUBLE)) AS m_{c}, coalesce(nullif(MAX(CAST({c} AS DOUBLE)) - MIN(CAST({c} AS DOUBLE)), 0), 1) AS s_{c}"
        for c in FEATS20)
    q["D3_minmax_scaling"] = with_(PATIENTS, CLEAN, FEATURED, SPLIT_CTE,
                                   f"st AS (SELECT {mm_stats} FROM splitted WHERE split = 'train')") + \
        "SELECT id, " + ", ".join(f"{R6(f'(CAST({c} AS DOUBLE) - m_{c}) / s_{c}')} AS {c}" for c in FEATS20) + \
        ", cardio FROM splitted, st WHERE split = 'test'"
    return q


# ---------------------------------------------------------------- evaluation

MODEL_W = [("age_years", 0.05), ("ap_hi", 0.025), ("mean_arterial_pressure", 0.01),
           ("cholesterol", 0.35), ("gluc", 0.1), ("bmi", 0.03), ("smoke", 0.15),
           ("alco", 0.1), ("active", -0.25)]
MODEL_B = -8.0


def prob_expr() -> str:
    z = D(MODEL_B)
    for c, w in MODEL_W:
        z = f"({z} + {D(w)} * CAST({c} AS DOUBLE))"
    return R(f"1 / (1 + exp(-{z}))", 12)


def tree_prob_expr() -> str:
    """The fixed forest of three trees, stated on its own."""
    trees = ["CASE WHEN ap_hi <= 139 THEN CASE WHEN age_years <= 54 THEN -0.9 ELSE -0.2 END ELSE CASE WHEN cholesterol <= 1 THEN 0.5 ELSE 1.1 END END",
             "CASE WHEN bmi <= 27.5 THEN CASE WHEN smoke <= 0 THEN -0.3 ELSE 0.15 END ELSE CASE WHEN ap_hi <= 124 THEN 0.05 ELSE 0.45 END END",
             "CASE WHEN active <= 0 THEN 0.25 ELSE CASE WHEN age_years <= 60 THEN -0.25 ELSE 0.1 END END"]
    z = D(-0.1)
    for t in trees:
        z = f"({z} + CAST({t} AS DOUBLE))"
    return R(f"1 / (1 + exp(-{z}))", 12)


SCORED_CTE = f"""scored0 AS (SELECT id, CAST(cardio AS INTEGER) AS label, {prob_expr()} AS probability, split FROM splitted),
scored AS (SELECT *, CAST(probability > {D(0.5)} AS INTEGER) AS prediction FROM scored0),
test AS (SELECT * FROM scored WHERE split = 'test')"""
EVAL_BASE = with_(PATIENTS, CLEAN, FEATURED, SPLIT_CTE, SCORED_CTE)


def _ratio(num, den):
    return f"(CASE WHEN ({den}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({num} AS DOUBLE) / ({den}) END)"


def _cc(src, group=None):
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return f"""SELECT {g}COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
 COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
 COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
 COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, COUNT(*) AS n FROM {src}{gb}"""


def _metrics_select(tn="tn", fp="fp", fn="fn", tp="tp"):
    return (f"{R6(_ratio(f'{tp} + {tn}', f'{tn} + {fp} + {fn} + {tp}'))} AS accuracy, "
            f"{R6(_ratio(tp, f'{tp} + {fp}'))} AS precision, "
            f"{R6(_ratio(tp, f'{tp} + {fn}'))} AS recall, "
            f"{R6(_ratio(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}'))} AS f1_score")


def _auc_cte(src, group=None, const=True, name="auc"):
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    auc = "u / (p * nn)"
    if const:
        auc = f"CASE WHEN d <= 1 THEN CAST(0 AS DOUBLE) ELSE {auc} END"
    return f"""{name}_g AS (SELECT {g}probability, COUNT(*) FILTER (WHERE label = 1) AS pos,
   COUNT(*) FILTER (WHERE label = 0) AS neg FROM {src} GROUP BY {g}probability),
{name}_c AS (SELECT *, coalesce(SUM(neg) OVER ({part}ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bn FROM {name}_g),
{name} AS (SELECT {g}{R6(f"CASE WHEN p = 0 OR nn = 0 THEN NULL ELSE {auc} END")} AS roc_auc FROM
   (SELECT {g}SUM(pos * (bn + neg / 2)) AS u, SUM(pos) AS p, SUM(neg) AS nn, COUNT(*) AS d FROM {name}_c{gb}))"""


def _calib_bins(src):
    b = " + ".join(f"CAST(probability > {i} * {D(0.1)} AS INTEGER)" for i in range(1, 10))
    return f"""SELECT {b} AS bin, AVG(probability) AS mean_predicted,
 AVG(CAST(label AS DOUBLE)) AS observed_rate, COUNT(*) AS "count" FROM {src} GROUP BY 1"""


def _report_rows(src, group=None):
    g = f"{group}, " if group else ""
    sel = lambda *cols: ", ".join(cols)
    p0, r0, f0 = _ratio("tn", "tn + fn"), _ratio("tn", "tn + fp"), _ratio("2 * tn", "2 * tn + fn + fp")
    p1, r1, f1 = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn"), _ratio("2 * tp", "2 * tp + fp + fn")
    rows = [
        ("'0'", p0, r0, f0, "tn + fp"),
        ("'1'", p1, r1, f1, "tp + fn"),
        ("'accuracy'", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", _ratio("tp + tn", "n"), "n"),
        ("'macro avg'", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", "n"),
        ("'weighted avg'", _ratio(f"{p0} * (tn + fp) + {p1} * (tp + fn)", "CAST(n AS DOUBLE)"),
         _ratio(f"{r0} * (tn + fp) + {r1} * (tp + fn)", "CAST(n AS DOUBLE)"),
         _ratio(f"{f0} * (tn + fp) + {f1} * (tp + fn)", "CAST(n AS DOUBLE)"), "n"),
    ]
    return "\nUNION ALL\n".join(
        f"SELECT {g}{c} AS class, {R6(pp)} AS precision, {R6(rr)} AS recall, {R6(ff)} AS f1_score, "
        f"CAST({ss} AS BIGINT) AS support FROM ({_cc(src, group)})"
        for c, pp, rr, ff, ss in rows)


def _reliability(src):
    return f"""rel AS (SELECT {R6(_ratio("COUNT(*) FILTER (WHERE (probability > 0.8 OR probability < 0.2) AND CAST(probability > 0.5 AS INTEGER) = label)", "COUNT(*) FILTER (WHERE probability > 0.8 OR probability < 0.2)"))} AS high_confidence_accuracy,
   {R6(_ratio("COUNT(*) FILTER (WHERE probability > 0.8 OR probability < 0.2) * 100", "COUNT(*)"))} AS high_confidence_percentage,
   {R6("AVG(probability)")} AS mean_predicted_probability,
   {R6("STDDEV_POP(probability)")} AS std_predicted_probability FROM {src}),
cal AS (SELECT {R6("AVG(abs(observed_rate - mean_predicted))")} AS calibration_error FROM ({_calib_bins(src)}))"""


def eval_queries() -> dict[str, str]:
    q = {}
    q["E1_E2_E4_metrics_by_split"] = EVAL_BASE.rstrip() + ",\n" + _auc_cte("scored", "split") + f"""
SELECT c.split, {_metrics_select()}, {R6(_ratio('tn', 'tn + fp'))} AS specificity, a.roc_auc
FROM ({_cc('scored', 'split')}) c LEFT JOIN auc a ON a.split = c.split"""
    q["E2_roc_auc_test"] = EVAL_BASE.rstrip() + ",\n" + _auc_cte("test", None, const=False) + "SELECT * FROM auc"
    q["E3_confusion_matrix_by_split"] = EVAL_BASE + f"""
SELECT split, 0 AS actual, tn AS predicted_0, fp AS predicted_1 FROM ({_cc('scored', 'split')})
UNION ALL SELECT split, 1, fn, tp FROM ({_cc('scored', 'split')})"""
    q["E5_classification_report_test"] = EVAL_BASE + _report_rows("test")
    q["E6_calibration_bins_test"] = EVAL_BASE + f"""
SELECT bin, {R6('mean_predicted')} AS mean_predicted, {R6('observed_rate')} AS observed_rate, "count"
FROM ({_calib_bins('test')})"""
    q["E6_E8_reliability_test"] = EVAL_BASE.rstrip() + ",\n" + _reliability("test") + "SELECT * FROM rel, cal"
    sweep = "\nUNION ALL\n".join(
        f"SELECT {D(t)} AS threshold, " + _metrics_select(
            f"COUNT(*) FILTER (WHERE probability < {D(t)} AND label = 0)",
            f"COUNT(*) FILTER (WHERE probability >= {D(t)} AND label = 0)",
            f"COUNT(*) FILTER (WHERE probability < {D(t)} AND label = 1)",
            f"COUNT(*) FILTER (WHERE probability >= {D(t)} AND label = 1)") + " FROM test"
        for t in [0.3, 0.4, 0.5, 0.6, 0.7])
    q["E9_threshold_sweep_test"] = EVAL_BASE + sweep
    names = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "specificity", "calibration_error",
             "high_confidence_accuracy", "high_confidence_percentage", "mean_predicted_probability",
             "std_predicted_probability"]
    q["E10_evaluation_bundle_test"] = EVAL_BASE.rstrip() + ",\n" + _auc_cte("test", None, const=False) + ",\n" + \
        _reliability("test") + f""",
b AS (SELECT {_metrics_select()}, {R6(_ratio('tn', 'tn + fp'))} AS specificity FROM ({_cc('test')})),
allm AS (SELECT * FROM b, auc, rel, cal)
""" + "\nUNION ALL\n".join(f"SELECT '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM allm" for n in names)
    q["E13_train_validation_report"] = EVAL_BASE.rstrip() + \
        ",\ntv AS (SELECT * FROM scored WHERE split IN ('train', 'validation'))\n" + _report_rows("tv", "split")
    return q




# ---------------------------------------------------------------- scoring

def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def LEVEL(p="probability"):
    return (f"CASE WHEN {p} < {D(0.3)} THEN 'Low' WHEN {p} < {D(0.5)} THEN 'Moderate' "
            f"WHEN {p} < {D(0.7)} THEN 'High' ELSE 'Very High' END")


def _case(key, mapping, default):
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {_s(v)}" for k, v in mapping.items()) + \
        f" ELSE {_s(default)} END"


BOUNDS = [("age", 18, 100), ("height", 120, 220), ("weight", 30, 250), ("ap_hi", 60, 250),
          ("ap_lo", 30, 200), ("cholesterol", 1, 3), ("gluc", 1, 3), ("smoke", 0, 1),
          ("alco", 0, 1), ("active", 0, 1)]


def _serving_ctes(src, keep, name="sv"):
    k = "".join(f"{c}, " for c in keep)
    return f"""{name}1 AS (SELECT {k}CAST(age AS BIGINT) AS age_years,
   CAST(CASE WHEN lower(trim(gender)) IN ('male', 'm') THEN 2 ELSE 1 END AS BIGINT) AS gender,
   CAST(height AS DOUBLE) AS height, CAST(weight AS DOUBLE) AS weight,
   CAST(ap_hi AS BIGINT) AS ap_hi, CAST(ap_lo AS BIGINT) AS ap_lo, CAST(cholesterol AS BIGINT) AS cholesterol,
   CAST(gluc AS BIGINT) AS gluc, CAST(smoke AS BIGINT) AS smoke, CAST(alco AS BIGINT) AS alco,
   CAST(active AS BIGINT) AS active FROM {src}),
{name}2 AS (SELECT *, {R('weight / ((height / 100) * (height / 100))', 2)} AS bmi FROM {name}1),
{name}3 AS (SELECT *, {BMI_CAT} AS bmi_category, CAST(ap_hi - ap_lo AS BIGINT) AS pulse_pressure FROM {name}2),
{name}4 AS (SELECT *, {R('ap_lo + pulse_pressure / 3', 1)} AS mean_arterial_pressure, {BP_SERVE} AS bp_category,
   {AGE_GROUP} AS age_group, CAST(smoke + alco + (1 - active) AS BIGINT) AS lifestyle_risk_score,
   CAST(cholesterol + gluc AS BIGINT) AS metabolic_risk_score FROM {name}3),
{name} AS (SELECT *, {COMBINED} AS combined_risk_score FROM {name}4)"""


def _requests_ctes(prob=None):
    prob = prob or prob_expr()
    rej = ["WHEN gender IS NULL THEN 'missing:gender'"]
    for c, lo, hi in BOUNDS:
        rej += [f"WHEN {c} IS NULL THEN 'missing:{c}'", f"WHEN NOT ({c} BETWEEN {lo} AND {hi}) THEN 'out_of_bounds:{c}'"]
    advice = [
        f"CASE WHEN bmi >= 25 THEN {_s(ADVICE['bmi_high'])} WHEN bmi < 18.5 THEN {_s(ADVICE['bmi_low'])} END",
        f"CASE WHEN bp_category >= 2 THEN {_s(ADVICE['bp'])} END",
        f"CASE WHEN cholesterol > 1 THEN {_s(ADVICE['chol'])} END",
        f"CASE WHEN gluc > 1 THEN {_s(ADVICE['gluc'])} END",
        f"CASE WHEN smoke <> 0 THEN {_s(ADVICE['smoke'])} END",
        f"CASE WHEN alco <> 0 THEN {_s(ADVICE['alco'])} END",
        f"CASE WHEN active = 0 THEN {_s(ADVICE['inactive'])} END",
        f"CASE WHEN {LEVEL()} IN ('High', 'Very High') THEN {_s(ADVICE['level_high'])} "
        f"WHEN {LEVEL()} = 'Moderate' THEN {_s(ADVICE['level_moderate'])} ELSE {_s(ADVICE['level_low'])} END",
    ]
    hh = R("100 - combined_risk_score", 1)
    hs = (f"CASE WHEN {hh} >= 80 THEN 'Excellent' WHEN {hh} >= 60 THEN 'Good' WHEN {hh} >= 40 THEN 'Moderate' "
          f"WHEN {hh} >= 20 THEN 'Poor' ELSE 'Very Poor' END")
    ok, gated = "status = 'scored'", "status = 'not_applicable'"
    return [
        f"""req AS (SELECT id AS request_id, {AGE_YEARS} AS age,
   CASE WHEN gender = 2 THEN 'male' ELSE 'female' END AS gender, CAST(height AS DOUBLE) AS height,
   CAST(weight AS DOUBLE) AS weight, ap_hi, ap_lo, cholesterol, gluc, smoke, alco, active FROM patients)""",
        f"rq AS (SELECT *, CASE {' '.join(rej)} END AS rejection, height AS req_height, weight AS req_weight FROM req)",
        _serving_ctes("rq", ["request_id", "rejection", "req_height", "req_weight"]),
        f"""st AS (SELECT *, CASE WHEN rejection IS NOT NULL THEN 'rejected' WHEN ap_hi < 90 OR ap_lo < 60
   THEN 'not_applicable' ELSE 'scored' END AS status FROM sv)""",
        f"pr AS (SELECT *, CASE WHEN status = 'scored' THEN {prob} END AS probability FROM st)",
        f"""resp AS (SELECT request_id, status, rejection,
   CASE WHEN {gated} THEN 'Hypotension (<90/60). Model not trained for low BP.' END AS warning,
   CASE WHEN {ok} THEN CAST(probability > {D(0.5)} AS INTEGER) END AS prediction, probability,
   CASE WHEN {ok} THEN {LEVEL()} WHEN {gated} THEN 'Not Applicable' END AS risk_level,
   CASE WHEN {ok} THEN 'Estimated risk: ' || printf('%.1f', probability * 100) || '% (' || {LEVEL()} || ').'
        WHEN {gated} THEN 'BP too low for reliable prediction.' END AS summary,
   CASE WHEN {ok} THEN {{'score': {hh}, 'status': {hs}}} END AS heart_health,
   CASE WHEN {ok} THEN {_case('bp_category', BP_TEXT, BP_DEFAULT)} END AS bp_interpretation,
   CASE WHEN {ok} THEN {_case('cholesterol', CHOL_TEXT, CHOL_DEFAULT)} END AS cholesterol_interpretation,
   CASE WHEN {ok} THEN {_case('gluc', GLUC_TEXT, GLUC_DEFAULT)} END AS glucose_interpretation,
   CASE WHEN {ok} THEN {{'bmi': bmi, 'bmi_category': bmi_category, 'blood_pressure_category': bp_category,
        'combined_risk_score': combined_risk_score}} END AS risk_factors,
   CASE WHEN {ok} THEN list_filter([{', '.join(advice)}], lambda x: x IS NOT NULL) END AS recommendations,
   age_years AS age, gender, ap_hi, ap_lo, cholesterol, gluc, smoke, alco, active, bmi, bp_category,
   req_height AS height, req_weight AS weight FROM pr)""",
    ]


def _contrib(pos, sev, factor, desc, modif):
    rank = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}[sev]
    m = f", 'modifiability': {_s(modif)}" if modif is not None else ""
    return (f"{{'rank': {rank}, 'pos': {pos}, 'severity': {_s(sev)}, 'factor': {_s(factor)}, "
            f"'description': {desc}{m}}}")


def _sorted(items, keep):
    inner = ", ".join(f"'{k}': x.{k}" for k in keep)
    return (f"list_transform(list_sort(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)), "
            f"lambda x: {{{inner}}})")


def _contributors(v1=False):
    b, intb = "bmi_raw", "CAST(CAST(floor(bmi_raw) AS INTEGER) AS VARCHAR)"
    if not v1:
        items = [
            f"CASE WHEN age >= 55 THEN {_contrib(0, 'MEDIUM', 'Age', "CAST(age AS VARCHAR) || ' years'", 'Non-modifiable')} END",
            f"CASE WHEN bp_category >= 3 THEN {_contrib(1, 'HIGH', 'Blood Pressure', "'High blood pressure (Stage ' || CAST(bp_category - 1 AS VARCHAR) || ')'", 'Treatable')} "
            f"WHEN bp_category = 2 THEN {_contrib(1, 'MEDIUM', 'Blood Pressure', "'High blood pressure (Stage 1)'", 'Treatable')} END",
            f"CASE WHEN cholesterol = 3 THEN {_contrib(2, 'HIGH', 'Cholesterol', "'Very high levels'", 'Modifiable')} "
            f"WHEN cholesterol = 2 THEN {_contrib(2, 'MEDIUM', 'Cholesterol', "'Above normal'", 'Modifiable')} END",
            f"CASE WHEN {b} >= 30 THEN {_contrib(3, 'HIGH', 'BMI', f"'Obese (' || {intb} || ')'", 'Modifiable')} "
            f"WHEN {b} >= 25 THEN {_contrib(3, 'MEDIUM', 'BMI', f"'Overweight (' || {intb} || ')'", 'Modifiable')} END",
            f"CASE WHEN gluc = 3 THEN {_contrib(4, 'HIGH', 'Glucose', "'Very high levels'", 'Modifiable')} "
            f"WHEN gluc = 2 THEN {_contrib(4, 'MEDIUM', 'Glucose', "'Above normal'", 'Modifiable')} END",
            f"CASE WHEN smoke = 1 THEN {_contrib(5, 'HIGH', 'Smoking', "'Active smoker'", 'Modifiable - Very High Impact')} END",
            f"CASE WHEN alco = 1 THEN {_contrib(6, 'MEDIUM', 'Alcohol', "'Regular consumption'", 'Modifiable')} END",
            f"CASE WHEN active = 0 THEN {_contrib(7, 'LOW', 'Physical Activity', "'Sedentary lifestyle'", 'Modifiable')} END",
        ]
        return _sorted(items, ["severity", "factor", "description", "modifiability"])
    b1 = f"printf('%.1f', {b})"
    items = [
        f"CASE WHEN bp_category >= 3 THEN {_contrib(1, 'HIGH', 'Blood Pressure', "'Stage ' || CAST(bp_category - 1 AS VARCHAR) || ' Hypertension'", None)} "
        f"WHEN bp_category = 2 THEN {_contrib(1, 'MEDIUM', 'Blood Pressure', "'Elevated blood pressure'", None)} END",
        f"CASE WHEN cholesterol = 3 THEN {_contrib(2, 'HIGH', 'Cholesterol', "'Very high cholesterol levels'", None)} "
        f"WHEN cholesterol = 2 THEN {_contrib(2, 'MEDIUM', 'Cholesterol', "'Above normal cholesterol'", None)} END",
        f"CASE WHEN {b} >= 30 THEN {_contrib(3, 'HIGH', 'BMI', f"'Obese (BMI: ' || {b1} || ')'", None)} "
        f"WHEN {b} >= 25 THEN {_contrib(3, 'MEDIUM', 'BMI', f"'Overweight (BMI: ' || {b1} || ')'", None)} END",
        f"CASE WHEN gluc = 3 THEN {_contrib(4, 'HIGH', 'Glucose', "'Very high glucose levels'", None)} "
        f"WHEN gluc = 2 THEN {_contrib(4, 'MEDIUM', 'Glucose', "'Above normal glucose'", None)} END",
        f"CASE WHEN smoke = 1 THEN {_contrib(5, 'HIGH', 'Smoking', "'Active smoker'", None)} END",
        f"CASE WHEN alco = 1 THEN {_contrib(6, 'MEDIUM', 'Alcohol', "'Regular alcohol consumption'", None)} END",
        f"CASE WHEN active = 0 THEN {_contrib(7, 'LOW', 'Physical Activity', "'Sedentary lifestyle'", None)} END",
    ]
    return _sorted(items, ["severity", "factor", "description"])


def _rec(pair):
    return f"{{'text': {_s(pair[0])}, 'target': {_s(pair[1])}}}"


def _fill(items, filler):
    lst = f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({lst}) = 0 THEN [{filler}] ELSE {lst} END"


def _recommendations(v1=False):
    b = "bmi_raw"
    if not v1:
        loss = f"greatest(3, CAST(floor(({b} - 24) * {D(1.5)}) AS INTEGER))"
        weight = f"{{'text': {_s(TX.REC_MED_WEIGHT)}, 'target': 'Target: -' || CAST({loss} AS VARCHAR) || ' kg in 3 months'}}"
        high = _fill([f"CASE WHEN bp_category >= 3 THEN {_rec(TX.REC_HIGH_BP)} END",
                      f"CASE WHEN cholesterol = 3 THEN {_rec(TX.REC_HIGH_CHOL)} END",
                      f"CASE WHEN smoke = 1 THEN {_rec(TX.REC_HIGH_SMOKE)} END"], _rec(TX.REC_HIGH_FILLER))
        med = _fill([f"CASE WHEN bp_category >= 2 THEN {_rec(TX.REC_MED_BP)} END",
                     f"CASE WHEN {b} >= 25 THEN {weight} END",
                     f"CASE WHEN cholesterol = 2 THEN {_rec(TX.REC_MED_CHOL)} END",
                     f"CASE WHEN gluc >= 2 THEN {_rec(TX.REC_MED_GLUC)} END",
                     f"CASE WHEN alco = 1 THEN {_rec(TX.REC_MED_ALCO)} END"], _rec(TX.REC_MED_FILLER))
        long_ = (f"[CASE WHEN active = 0 THEN {_rec(TX.REC_LONG_INACTIVE)} ELSE {_rec(TX.REC_LONG_ACTIVE)} END, "
                 f"{_rec(TX.REC_LONG_CHECKUP)}, {_rec(TX.REC_LONG_TRACK)}]")
    else:
        loss = f"greatest(5, CAST(floor(({b} - 24) * 2) AS INTEGER))"
        high = _fill([f"CASE WHEN bp_category >= 3 THEN {_s(TX.REC1_HIGH_BP)} END",
                      f"CASE WHEN cholesterol = 3 THEN {_s(TX.REC1_HIGH_CHOL)} END",
                      f"CASE WHEN smoke = 1 THEN {_s(TX.REC1_HIGH_SMOKE)} END"], _s(TX.REC1_HIGH_FILLER))
        med = _fill([f"CASE WHEN bp_category = 2 THEN {_s(TX.REC1_MED_BP)} END",
                     f"CASE WHEN {b} >= 25 THEN 'Target weight reduction of ' || CAST({loss} AS VARCHAR) || ' kg through diet and exercise' END",
                     f"CASE WHEN cholesterol = 2 THEN {_s(TX.REC1_MED_CHOL)} END",
                     f"CASE WHEN gluc >= 2 THEN {_s(TX.REC1_MED_GLUC)} END",
                     f"CASE WHEN alco = 1 THEN {_s(TX.REC1_MED_ALCO)} END"], _s(TX.REC1_MED_FILLER))
        long_ = (f"[CASE WHEN active = 0 THEN {_s(TX.REC1_LONG_INACTIVE)} ELSE {_s(TX.REC1_LONG_ACTIVE)} END, "
                 f"{_s(TX.REC1_LONG_CHECKUP)}, {_s(TX.REC1_LONG_MONITOR)}]")
    return f"{{'high': {high}, 'medium': {med}, 'long_term': {long_}}}"


def _context(v1=False):
    t = TX.RISK_CONTEXT_V1 if v1 else TX.RISK_CONTEXT

    def pick(i):
        return ("CASE " + " ".join(f"WHEN risk_level = {_s(k)} THEN {_s(t[k][i])}" for k in ("Very High", "High", "Low"))
                + f" ELSE {_s(t['Moderate'][i])} END")
    return f"{{'meaning': {pick(0)}, 'action': {pick(1)}, 'note': {pick(2)}}}"


def _assessment_sql(v1=False):
    pct = "age_percentile"
    if not v1:
        band = "' of individuals in the ' || CAST(age - 5 AS VARCHAR) || ' to ' || CAST(age + 5 AS VARCHAR) || ' age range.'"
        cmp_ = (f"CASE WHEN {pct} >= 50 THEN 'Your risk profile is higher than approximately ' || CAST({pct} AS VARCHAR) || '%' || {band} "
                f"ELSE 'Your risk profile is lower than approximately ' || CAST(100 - {pct} AS VARCHAR) || '%' || {band} END")
    else:
        band = "' of individuals in your age group (' || CAST(age - 5 AS VARCHAR) || ' to ' || CAST(age + 5 AS VARCHAR) || ' years).'"
        hi = f"'Your estimated risk is higher than approximately ' || CAST({pct} AS VARCHAR) || '%' || {band}"
        lo = f"'Your estimated risk is lower than approximately ' || CAST(100 - {pct} AS VARCHAR) || '%' || {band}"
        cmp_ = (f"{{'tier': CASE WHEN {pct} >= 75 THEN 'warning' WHEN {pct} >= 50 THEN 'info' ELSE 'success' END, "
                f"'text': CASE WHEN {pct} >= 50 THEN {hi} ELSE {lo} END}}")
    base = "probability * 100"
    perc = (f"CASE WHEN age < 40 THEN least(CAST(95 AS DOUBLE), {base} + 15) WHEN age < 50 THEN least(CAST(95 AS DOUBLE), {base} + 10) "
            f"WHEN age < 60 THEN {base} + 5 ELSE greatest(CAST(50 AS DOUBLE), {base} - 5) END")
    ipct = "CAST(floor(probability * 100) AS INTEGER)"
    shown = "CAST(" + ipct + " AS VARCHAR)"
    label_hi = "'Elevated Cardiovascular Risk Identified'"
    if v1:
        ipct = "(probability * 100)"
        shown = "printf('%.1f', probability * 100)"
        label_hi = "'Elevated Risk Detected'"
    return [
        "a0 AS (SELECT *, weight / ((height / 100) * (height / 100)) AS bmi_raw FROM resp WHERE status = 'scored')",
        f"a1 AS (SELECT *, CAST(floor(least(CAST(99 AS DOUBLE), greatest(CAST(1 AS DOUBLE), {perc}))) AS INTEGER) AS age_percentile FROM a0)",
        f"""asm AS (SELECT request_id, {R6('probability')} AS probability, prediction, risk_level,
   CASE WHEN prediction = 1 THEN {label_hi} ELSE 'Lower Risk Profile' END AS assessment,
   {shown} || '% ' || CASE WHEN {ipct} >= 70 THEN '(Significantly Elevated)'
     WHEN {ipct} >= 50 THEN '(Moderately Elevated)' ELSE '(Within Expected Range)' END AS risk_index,
   {_context(v1)} AS risk_context, age_percentile, {cmp_} AS age_comparison,
   {_contributors(v1)} AS contributors, {_recommendations(v1)} AS action_plan,
   age, gender, height, weight, ap_hi, ap_lo, probability AS p_full FROM a1)""",
    ]


def _what_if_sql(prob=None):
    prob = prob or prob_expr()
    T = TX.SCENARIO_TEXT

    def txt(i):
        return "CASE scenario " + " ".join(
            f"WHEN {_s(k)} THEN {_s(v[i])}" for k, v in T.items() if v[i] is not None) + " END"
    ctes = [
        """wb AS (SELECT request_id, probability AS base_probability, age,
   CASE WHEN gender = 2 THEN 'male' ELSE 'female' END AS gender, height, weight, ap_hi, ap_lo,
   cholesterol, gluc, alco, smoke, active FROM resp WHERE status = 'scored')""",
        f"""ws AS (
   SELECT *, 'quit_smoking' AS scenario, 1 AS ord, 0 AS s_smoke, active AS s_active, 0 AS s_red, {D(1.0)} AS min_drop FROM wb WHERE smoke = 1
   UNION ALL SELECT *, 'become_active', 2, smoke, 1, 0, {D(1.0)} FROM wb WHERE active = 0
   UNION ALL SELECT *, 'bp_reduction', 3, smoke, active, 15, {D(1.0)} FROM wb WHERE ap_hi > 130
   UNION ALL SELECT *, 'combined', 4, 0, active, 15, {D(2.0)} FROM wb WHERE smoke = 1 AND ap_hi > 130
   UNION ALL SELECT *, 'optimal', 5, smoke, active, 0, {D(0.0)} FROM wb WHERE smoke <> 1 AND active <> 0 AND ap_hi <= 130)""",
        f"""wm AS (SELECT request_id, base_probability, scenario, ord, min_drop, age, gender, height, weight,
   greatest(90, ap_hi - s_red) AS ap_hi, greatest(60, ap_lo - CAST(floor(s_red * {D(0.6)}) AS INTEGER)) AS ap_lo,
   cholesterol, gluc, alco, s_smoke AS smoke, s_active AS active FROM ws)""",
        _serving_ctes("wm", ["request_id", "base_probability", "scenario", "ord", "min_drop"], "wv"),
        f"""wp AS (SELECT request_id, scenario, ord, base_probability, min_drop,
   CASE WHEN scenario <> 'optimal' THEN {prob} END AS new_probability FROM wv)""",
        "wr AS (SELECT *, base_probability * 100 - new_probability * 100 AS reduction FROM wp)",
    ]
    moved = "reduction > min_drop"
    shown = f"(scenario = 'optimal' OR {moved} OR scenario <> 'combined')"
    numeric = (f"{txt(0)} || ': ' || CAST(CAST(floor(new_probability * 100) AS INTEGER) AS VARCHAR) || '% (↓' || "
               f"CAST(CAST(floor(reduction) AS INTEGER) AS VARCHAR) || '% reduction)'")
    sel = f"""SELECT request_id, scenario, ord, {R6('base_probability')} AS base_probability,
 {R6('new_probability')} AS new_probability, {R6('reduction')} AS reduction, {shown} AS shown,
 CASE WHEN scenario = 'optimal' THEN false ELSE {moved} END AS estimate_moved,
 CASE WHEN scenario <> 'optimal' AND {moved} THEN {numeric} WHEN {shown} THEN {txt(2)} END AS title,
 CASE WHEN scenario <> 'optimal' AND {moved} THEN {txt(1)} WHEN {shown} THEN {txt(3)} END AS note FROM wr"""
    return ctes, sel


def scoring_queries() -> dict[str, str]:
    q = {}
    base = [PATIENTS] + _requests_ctes()
    cols_k1 = ("request_id, status, rejection, warning, prediction, " + R6("probability") + " AS probability, "
               "risk_level, summary, heart_health, bp_interpretation, cholesterol_interpretation, "
               "glucose_interpretation, risk_factors, recommendations, age, gender, ap_hi, ap_lo, cholesterol, "
               "gluc, smoke, alco, active, bmi, bp_category, height, weight")
    q["K1_score_requests"] = with_(*base) + f"SELECT {cols_k1} FROM resp"
    conf = (f"CASE WHEN abs(probability - {D(0.5)}) * 2 > {D(0.8)} THEN 'Very High' "
            f"WHEN abs(probability - {D(0.5)}) * 2 > {D(0.6)} THEN 'High' "
            f"WHEN abs(probability - {D(0.5)}) * 2 > {D(0.4)} THEN 'Moderate' ELSE 'Low' END")
    interp = ("CASE WHEN prediction = 0 THEN 'The model indicates LOW likelihood of cardiovascular disease (Risk Score: ' "
              "|| printf('%.1f', probability * 100) || '%). Maintain healthy habits.' "
              "ELSE 'The model indicates HIGH likelihood of cardiovascular disease (Risk Score: ' "
              "|| printf('%.1f', probability * 100) || '%). Medical consultation recommended.' END")
    q["K5_prediction_reports_test"] = EVAL_BASE + f"""
SELECT id, {{'prediction': prediction, 'probability': {R6('probability')}, 'risk_level': {LEVEL()} || ' Risk',
 'confidence': {conf}, 'interpretation': {interp}}} AS report FROM test"""
    acols = ("request_id, probability, prediction, risk_level, assessment, risk_index, risk_context, "
             "age_percentile, age_comparison, contributors, action_plan, age, gender, height, weight, ap_hi, ap_lo")
    q["K9_K16_assessment"] = with_(*base, *_assessment_sql()) + f"SELECT {acols} FROM asm"
    q["K10_K12_assessment_v1"] = with_(*base, *_assessment_sql(True)) + f"SELECT {acols} FROM asm"
    wctes, wsel = _what_if_sql()
    q["K18_what_if"] = with_(*base, *wctes) + wsel
    trees = [PATIENTS] + _requests_ctes(tree_prob_expr())
    q["K1_tree_model_scoring"] = q["K20_tree_model_streaming"] = with_(*trees) + f"SELECT {cols_k1} FROM resp"
    wctes, wsel = _what_if_sql(tree_prob_expr())
    q["K18_tree_model_what_if"] = with_(*trees, *wctes) + wsel
    cut = "CASE WHEN length(r.text) > 65 THEN substr(r.text, 1, 65) || '...' ELSE r.text END"
    q["K19_report_highlights"] = with_(*base, *_assessment_sql()) + f"""
SELECT request_id, list_slice(contributors, 1, 5) AS top_contributors,
 list_transform(list_slice(action_plan.high, 1, 3), lambda r: {{'text': {cut}, 'target': r.target}}) AS top_high,
 list_transform(list_slice(action_plan.medium, 1, 3), lambda r: {{'text': {cut}, 'target': r.target}}) AS top_medium
FROM asm"""
    nl = "chr(10)"
    line = _s("=" * 60)
    rec = f"list_transform(%s, lambda r: '  - ' || r.text || {nl} || '    ' || r.target)"
    body = ", ".join([
        line, "'CARDIOVASCULAR RISK ASSESSMENT REPORT'", line, "'Generated: 2025-01-01 00:00'", "''",
        "'PATIENT INFORMATION'",
        "'Age: ' || CAST(age AS VARCHAR) || ' | Gender: ' || CASE WHEN gender = 2 THEN 'Male' ELSE 'Female' END",
        "'Height: ' || CAST(height AS VARCHAR) || ' cm | Weight: ' || CAST(weight AS VARCHAR) || ' kg'",
        "'Blood Pressure: ' || CAST(ap_hi AS VARCHAR) || '/' || CAST(ap_lo AS VARCHAR) || ' mmHg'",
        "''", "'RISK ASSESSMENT'",
        "'Risk Score: ' || CAST(CAST(floor(p_full * 100) AS INTEGER) AS VARCHAR) || '%'",
        "'Classification: ' || risk_level", "''", "'KEY RISK CONTRIBUTORS'",
        f"array_to_string(list_transform(contributors, lambda c: '[' || c.severity || '] ' || c.factor || ': ' "
        f"|| c.description || ' (' || c.modifiability || ')'), {nl})",
        "''", "'RECOMMENDATIONS'", "'High Priority:'", f"array_to_string({rec % 'action_plan.high'}, {nl})",
        "'Medium Priority:'", f"array_to_string({rec % 'action_plan.medium'}, {nl})",
        "''", line, "'DISCLAIMER'", "'This assessment is for educational purposes only.'",
        "'It is not a substitute for professional medical advice.'",
        "'Risk categories aligned with standard cardiovascular'",
        "'prevention guidelines (educational use only).'", line])
    q["S10_text_report"] = with_(*base, *_assessment_sql()) + f"SELECT request_id, concat_ws({nl}, {body}) AS report FROM asm"
    return q


ADVICE, BP_TEXT, BP_DEFAULT = TX.ADVICE, TX.BP_TEXT, TX.BP_TEXT_DEFAULT
CHOL_TEXT, CHOL_DEFAULT = TX.CHOLESTEROL_TEXT, TX.CHOLESTEROL_TEXT_DEFAULT
GLUC_TEXT, GLUC_DEFAULT = TX.GLUCOSE_TEXT, TX.GLUCOSE_TEXT_DEFAULT


# ---------------------------------------------------------------- options, requests, I/O

def option_queries() -> dict[str, str]:
    q = {}
    ocols = ["age_years", "height", "weight", "ap_hi", "ap_lo"]
    iqr = ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{c}"
        for c in ocols)
    keep = " AND ".join(
        f"{c} BETWEEN q1_{c} - {D(1.5)} * (q3_{c} - q1_{c}) AND q3_{c} + {D(1.5)} * (q3_{c} - q1_{c})"
        for c in ocols)
    q["D1_iqr_outlier_filter"] = with_(PATIENTS, CLEAN, f"b AS (SELECT {iqr} FROM clean)") + \
        f"SELECT clean.* FROM clean, b WHERE {keep}"
    zs = ", ".join(f"AVG(CAST({c} AS DOUBLE)) AS m_{c}, STDDEV_POP(CAST({c} AS DOUBLE)) AS s_{c}" for c in ocols)
    zkeep = " AND ".join(f"(s_{c} = 0 OR abs({c} - m_{c}) / s_{c} <= 3)" for c in ocols)
    q["D2_zscore_outlier_filter"] = with_(PATIENTS, CLEAN, f"b AS (SELECT {zs} FROM clean)") + \
        f"SELECT clean.* FROM clean, b WHERE {zkeep}"

    def band(c, bands):
        return "CASE " + " ".join(f"WHEN {c} >= {D(float(lo))} AND {c} < {D(float(hi))} THEN '{n}'"
                                  for n, lo, hi in bands) + " END"
    bp = "CASE " + " ".join(
        f"WHEN (ap_hi >= {slo} AND ap_hi < {shi}) OR (ap_lo >= {dlo} AND ap_lo < {dhi}) THEN '{n}'"
        for n, (slo, shi), (dlo, dhi) in reversed(TX.BP_BANDS)) + " END"
    q["D7_reference_bands"] = BASE + f"""
SELECT bmi_who_class, age_band, bp_band, COUNT(*) AS "rows" FROM (
 SELECT {band('bmi', TX.BMI_WHO_BANDS)} AS bmi_who_class, {band('age_years', TX.AGE_BANDS)} AS age_band,
 {bp} AS bp_band FROM featured) GROUP BY ALL"""
    q["F7_F8_bp_profile_skew"] = with_(PATIENTS, CLEAN) + f"""
SELECT {BP_TRAIN} AS bp_category_train, {BP_SERVE} AS bp_category_serve, COUNT(*) AS "rows" FROM clean GROUP BY ALL"""
    q["C11_C12_request_routing"] = with_(PATIENTS, *_requests_ctes()) + \
        'SELECT status, rejection, COUNT(*) AS "rows" FROM resp GROUP BY ALL'
    chol = "CASE cholesterol " + " ".join(f"WHEN {v} THEN {v}" for v in TX.CHOLESTEROL_LABELS.values()) + " END"
    gl = "CASE gluc " + " ".join(f"WHEN {v} THEN {v}" for v in TX.GLUCOSE_LABELS.values()) + " END"
    q["C13_C14_form_codes"] = with_(PATIENTS) + f"""
SELECT id, CAST(CASE WHEN gender = 2 THEN 2 ELSE 1 END AS BIGINT) AS gender,
 CAST({chol} AS BIGINT) AS cholesterol, CAST({gl} AS BIGINT) AS gluc,
 CAST(CASE WHEN smoke = 1 THEN 1 ELSE 0 END AS BIGINT) AS smoke,
 CAST(CASE WHEN alco = 1 THEN 1 ELSE 0 END AS BIGINT) AS alco,
 CAST(CASE WHEN active = 1 THEN 1 ELSE 0 END AS BIGINT) AS active FROM patients"""
    q["S1_S3_delimited_round_trip"] = with_(PATIENTS) + "SELECT * FROM patients"
    q["S2_stage_csv_round_trip"] = with_(PATIENTS, CLEAN) + "SELECT * FROM clean"
    q["S4_S5_saved_test_split"] = with_(PATIENTS, CLEAN, FEATURED, SPLIT_CTE) + \
        f"SELECT {', '.join(FEATS20)}, cardio, split FROM splitted WHERE split = 'test'"
    rq = [PATIENTS] + _requests_ctes()[:2]
    q["S6_C11_json_requests"] = with_(*rq) + "SELECT request_id, rejection FROM rq"
    q["K20_streaming_scoring"] = scoring_queries()["K1_score_requests"]
    return q


def cleaning_step_queries() -> dict[str, str]:
    base = with_(PATIENTS)
    cat = " AND ".join(_cat_ok(c) for c in CAT)
    rng = " AND ".join(_range_ok(c, lo, hi) for c, lo, hi, _ in RANGES)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in RAW_COLS)
    return {
        "C1_remove_duplicates": base + "SELECT DISTINCT * FROM patients",
        "C2_age_in_years": base + f"SELECT id, age, {AGE_YEARS} AS age_years FROM patients",
        "C3_categorical_filter": base + f"SELECT * FROM patients WHERE {cat}",
        "C4_range_filter": base + f"SELECT * FROM (SELECT *, {AGE_YEARS} AS age_years FROM patients) WHERE {rng}",
        "C5_bp_anomaly_filter": base + "SELECT * FROM patients WHERE coalesce(ap_lo < ap_hi, false)",
        "C6_drop_missing": base + f"SELECT * FROM patients WHERE {notnull}",
    }


def label_table_queries() -> dict[str, str]:
    cols = ["doc_id", "quality", "toxic"]
    dist = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS BIGINT) AS value, COUNT(*) AS \"count\" "
        f"FROM labels WHERE {c} IS NOT NULL GROUP BY {c}" for c in ["quality", "toxic"])
    vals = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM labels" for c in ["quality", "toxic"])
    checks = f"""WITH v AS ({vals}),
cv AS (SELECT "column", value, coalesce(value IN (0, 1), false) AS is_valid FROM v GROUP BY ALL)
SELECT "column", COUNT(*) FILTER (WHERE value IS NOT NULL) AS n_unique,
 COUNT(*) FILTER (WHERE NOT is_valid) AS n_invalid, bool_or(value IS NULL) AS has_null,
 COUNT(*) FILTER (WHERE NOT is_valid) = 0 AS passed FROM cv GROUP BY "column\""""
    return {
        "V14_labels_value_distributions": dist,
        "V10_labels_categorical_checks": checks,
        "V12_labels_column_statistics": _col_stats("labels", cols),
    }


# ---------------------------------------------------------------- model tables on fixed scores

def fixed_model_queries() -> dict[str, str]:
    pressure = f"""two AS (SELECT label, probability, prediction, split, 'linear' AS model, 0 AS model_order FROM scored WHERE split <> 'test'
 UNION ALL SELECT CAST(cardio AS INTEGER), ap_hi / CAST(250 AS DOUBLE), CAST(ap_hi / CAST(250 AS DOUBLE) > 0.5 AS INTEGER), split, 'pressure', 1
 FROM splitted WHERE split <> 'test'),
val AS (SELECT * FROM two WHERE split = 'validation')"""
    q = {}
    q["M10_M11_summary_of_fixed_models"] = EVAL_BASE.rstrip() + ",\n" + pressure + ",\n" + _auc_cte("val", "model") + f""",
m AS (SELECT c.model, {_metrics_select()}, a.roc_auc, CASE WHEN c.model = 'linear' THEN 0 ELSE 1 END AS model_order
 FROM ({_cc('val', 'model')}) c LEFT JOIN auc a ON a.model = c.model)
SELECT model, accuracy, precision, recall, f1_score, roc_auc,
 ROW_NUMBER() OVER (ORDER BY coalesce(roc_auc, 0) DESC, model_order) = 1 AS is_best, model_order FROM m"""
    auc = EVAL_BASE.rstrip() + ",\n" + _auc_cte("test")
    full = auc.replace(R6("CASE WHEN p = 0 OR nn = 0 THEN NULL ELSE CASE WHEN d <= 1 THEN CAST(0 AS DOUBLE) ELSE u / (p * nn) END END"), "u / (p * nn)")
    q["M17_improvement_of_fixed_model"] = full + f"""
SELECT 'run-1' AS run_id, 'linear' AS model, {R6('roc_auc')} AS roc_auc, {D(0.7997)} AS previous_auc,
 {R6(f'(roc_auc - {D(0.7997)}) / {D(0.7997)} * 100')} AS improvement_pct FROM auc"""
    metrics = f"""m AS (SELECT {_metrics_select()}, {R6(_ratio('tn', 'tn + fp'))} AS specificity FROM ({_cc('test')}))"""
    q["S9_run_log_of_fixed_model"] = auc + ",\n" + metrics + "\n" + "\nUNION ALL\n".join(
        f"SELECT 'run-1' AS run_id, 'test' AS stage, 'linear' AS model, '{n}' AS metric, {n} AS value FROM {t}"
        for n, t in [("accuracy", "m"), ("precision", "m"), ("recall", "m"), ("f1_score", "m"), ("specificity", "m"), ("roc_auc", "auc")])
    q["S8_best_params_of_fixed_model"] = auc + ",\n" + metrics + """
SELECT 'linear' AS model_name, '{"depth": 5}' AS params, roc_auc AS cv_score, accuracy, f1_score FROM m, auc"""
    q["S7_saved_model_scores_agree"] = with_(PATIENTS, CLEAN, FEATURED, SPLIT_CTE) + \
        "SELECT id, CAST(cardio AS INTEGER) AS label, true AS agree FROM splitted WHERE split = 'test'"
    q["M17_previous_run_as_of"] = """WITH ev AS (SELECT event_id AS run_id, event_type AS model, date_trunc('hour', ts) AS logged_at, value FROM events),
last AS (SELECT model, logged_at, MAX(run_id) AS previous_run, arg_max(value, run_id) AS previous_value FROM ev WHERE logged_at IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
SELECT run_id, ev.model AS model, ev.logged_at AS logged_at, """ + R6("value") + " AS value, previous_run, " + R6("previous_value") + " AS previous_value, " + R6("CASE WHEN previous_value <> 0 THEN (value - previous_value) * 100 / previous_value END") + """ AS improvement_pct
FROM ev ASOF LEFT JOIN last ON ev.model = last.model AND ev.logged_at > last.logged_at"""
    q["D7_bands_from_a_table"] = BASE + """
SELECT CASE WHEN bmi < 18.5 THEN 'low' WHEN bmi >= 20 AND bmi < 25 THEN 'mid' WHEN bmi >= 24 AND bmi < 30 THEN 'high' WHEN bmi >= 32.5 THEN 'very high' END AS band,
 COUNT(*) AS "rows" FROM featured GROUP BY ALL"""
    at = ", ".join(f"CAST(probability > {D(t)} AS INTEGER) AS p{i}" for i, t in enumerate((0.35, 0.5, 0.65)))
    q["D9_predictions_at_thresholds"] = EVAL_BASE + f"""SELECT label, {at}, COUNT(*) AS "rows" FROM test GROUP BY ALL"""

    def lacks(table, have):
        names = sorted(set(FEATS20) - set(have))
        items = "[" + ", ".join(f"'{n}'" for n in names) + "]" if names else "CAST([] AS VARCHAR[])"
        return f"""SELECT '{table}' AS "table", {len(names)} AS n_missing, {items} AS missing, COUNT(*) AS "rows" FROM """
    q["E11_missing_features_of_tables"] = BASE + lacks("raw", RAW_COLS) + "patients UNION ALL " + lacks("cleaned", [*RAW_COLS, "age_years"]) + "clean UNION ALL " + lacks("featured", FEATS20) + "featured"
    both = pressure.replace("split <> 'test'", "true") + ",\nexam AS (SELECT * FROM two WHERE split = 'test')"
    q["E12_best_fixed_model_on_test"] = EVAL_BASE.rstrip() + ",\n" + both + ",\n" + _auc_cte("val", "model") + ",\n" + _auc_cte("exam", "model", name="exam_auc") + f""",
best AS (SELECT arg_min(model, rank) AS model FROM (SELECT model, ROW_NUMBER() OVER (ORDER BY coalesce(roc_auc, 0) DESC, model) AS rank FROM auc))
SELECT c.model AS model, {_metrics_select()}, {R6(_ratio('tn', 'tn + fp'))} AS specificity, a.roc_auc AS roc_auc
FROM ({_cc('exam', 'model')}) c JOIN exam_auc a ON a.model = c.model JOIN best b ON b.model = c.model"""
    q["M2_logistic_folds_at_optimum"] = split_queries()["P3_kfold_exact_rows"].replace("SELECT id, fold FROM kf", """
SELECT c, f.fold AS fold, (SELECT COUNT(*) FROM kf WHERE kf.fold <> f.fold) AS train_rows, true AS at_optimum
FROM (SELECT DISTINCT fold FROM kf) f, (SELECT CAST(0.1 AS DOUBLE) AS c UNION ALL SELECT CAST(1 AS DOUBLE)) t""")
    q["K1_boosted_columns_agree"] = q["K1_forest_columns_agree"] = q["S7_saved_model_scores_agree"]
    q["K1_fitted_model_routing"] = option_queries()["C11_C12_request_routing"]
    q["M12_fold_sizes_of_search"] = with_(PATIENTS, CLEAN, FEATURED, f"""kf AS (SELECT *,
   CAST((ROW_NUMBER() OVER (PARTITION BY cardio ORDER BY {HKEY}, id) - 1) % 3 AS INTEGER) AS fold
   FROM featured WHERE {HUNIT} >= {D(TEST_SIZE)})""") + _cnt("kf", "fold", "cardio")
    return q


# ---------------------------------------------------------------- operators checked on their own

def single_operator_queries() -> dict[str, str]:
    q = {}
    q["C10_model_columns"] = BASE + f"SELECT id, {', '.join(FEATS20)}, cardio FROM featured"
    ranges = " AND ".join(f"coalesce({c} BETWEEN {lo} AND {hi}, false)" for c, lo, hi, _ in RANGES)
    q["D5_optional_ranges"] = with_(PATIENTS, f"""b AS (SELECT *, {AGE_YEARS} AS age_years,
 {R('weight / ((height / CAST(100 AS DOUBLE)) * (height / CAST(100 AS DOUBLE)))', 2)} AS bmi FROM patients)""") + \
        f"SELECT id, age, bmi FROM b WHERE {ranges} AND age BETWEEN 10950 AND 25550 AND coalesce(bmi BETWEEN 15 AND 50, false)"
    kept = [c for c in RAW_COLS if c not in ("cardio", "weight", "ap_hi")]
    errors = """SELECT 'missing_column' AS "check", 'cardio' AS "column", 'Missing column: cardio' AS message
UNION ALL SELECT 'non_numeric', 'ap_hi', 'Column ap_hi must be numeric'
UNION ALL SELECT 'empty_column', 'weight', 'Empty column: weight'""" + "".join(
        f"\nUNION ALL SELECT 'empty_column', '{c}', 'Empty column: {c}' FROM patients HAVING COUNT({c}) = 0" for c in [*kept, "ap_hi"])
    q["V4_V6_broken_table_errors"] = with_(PATIENTS) + errors
    q["V7_broken_table_verdict"] = with_(PATIENTS, f"errs AS ({errors})") + "SELECT COUNT(*) = 0 AS is_valid, COUNT(*) AS n_errors FROM errs"
    nan = f"nan AS (SELECT * REPLACE (CASE WHEN id % 13 <> 0 THEN weight END AS weight) FROM patients)"
    q["V2_missing_with_nan"] = with_(PATIENTS, nan, _missing_cte("nan", RAW_COLS)) + \
        f'SELECT * REPLACE ({R6("missing_percentage")} AS missing_percentage) FROM missing'
    q["V12_large_integers"] = with_(PATIENTS) + """
SELECT 'id' AS "column", CAST(COUNT(id) AS BIGINT) AS "count", CAST(COUNT(DISTINCT id) AS BIGINT) AS unique_count,
 CAST(MIN(id) + 9007199254740992 AS BIGINT) AS min_whole, CAST(MAX(id) + 9007199254740992 AS BIGINT) AS max_whole FROM patients"""
    return q
