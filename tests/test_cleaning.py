"""Cleaning operators on inline frames (mirrors the reference's unit tests)."""

from pyspark.sql import functions as F

from tests.conftest import raw_frame
from vitalframe.operators import clean as C


def _row(i, age=18250, gender=1, height=170, weight=70.0, ap_hi=120, ap_lo=80,
         chol=1, gluc=1, smoke=0, alco=0, active=1, cardio=0):
    return (i, age, gender, height, weight, ap_hi, ap_lo, chol, gluc, smoke, alco, active, cardio)


def test_remove_duplicates_keeps_one_copy(spark):
    rows = [_row(1), _row(2), _row(3), _row(3), _row(4)]
    df = raw_frame(spark, rows)
    assert df.count() - C.remove_duplicates(df).count() == 1


def test_age_days_to_years_half_even(spark):
    df = raw_frame(spark, [_row(i, age=a) for i, a in enumerate([18250, 20075, 21900, 25550])])
    got = [r.age_years for r in C.convert_age_to_years(df).orderBy("id").collect()]
    assert got == [50, 55, 60, 70]
    assert all(30 <= a <= 80 for a in got)
    # 1826 days = 4.9993 years -> 5.
    five = raw_frame(spark, [_row(0, age=1826)])
    assert C.convert_age_to_years(five).first().age_years == 5


def test_bp_anomalies_dropped(spark):
    his, los = [120, 130, 80, 140, 90], [80, 85, 100, 90, 95]
    df = raw_frame(spark, [_row(i, ap_hi=h, ap_lo=lo) for i, (h, lo) in enumerate(zip(his, los))])
    assert df.count() - C.filter_bp_anomalies(df).count() == 2


def test_categorical_and_range_filters(spark):
    rows = [_row(1), _row(2, gender=3), _row(3, chol=4), _row(4, height=139), _row(5, weight=None),
            _row(6, ap_hi=201), _row(7, age=30000)]
    df = raw_frame(spark, rows)
    out = C.clean(df)
    assert [r.id for r in out.collect()] == [1]


def test_rejection_report_first_failure(spark):
    rows = [_row(1), _row(1), _row(2, gender=3, height=100), _row(3, height=100),
            _row(4, ap_hi=100, ap_lo=100), _row(5, weight=None)]
    rep = {(r.step, r.rule): r.rows for r in C.rejection_report(raw_frame(spark, rows)).collect()}
    assert rep[("initial_shape", "rows")] == 6
    assert rep[("duplicates_removed", "all_columns")] == 1
    assert rep[("invalid_categorical", "gender")] == 1      # charged before the height rule
    assert rep[("outlier", "height")] == 1
    assert rep[("outlier", "bp_anomalies")] == 1
    assert rep[("outlier", "weight")] == 1                  # a null fails the range rule
    assert rep[("final_shape", "rows")] == 1
    # The report agrees with the cleaning pipeline itself.
    assert C.clean(raw_frame(spark, rows)).count() == rep[("final_shape", "rows")]


def test_clean_filters_pushed_below_dedup(spark):
    from vitalframe.plans import batch
    plan = batch.cleaned(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # The rule filter runs before the de-duplication aggregate's shuffle.
    assert plan.index("Filter") > plan.index("Exchange")


def test_request_validation_and_gate(spark):
    from vitalframe.operators.score import score_requests
    from vitalframe.schema import REQUEST_SCHEMA
    rows = [(1, 50, "male", 170.0, 70.0, 120, 80, 1, 1, 0, 0, 1),
            (2, 50, "female", 170.0, 70.0, 85, 55, 1, 1, 0, 0, 1),
            (3, 10, "female", 170.0, 70.0, 120, 80, 1, 1, 0, 0, 1),
            (4, 50, None, 170.0, 70.0, 120, 80, 1, 1, 0, 0, 1)]
    out = {r.request_id: r for r in score_requests(spark.createDataFrame(rows, REQUEST_SCHEMA)).collect()}
    assert out[1].status == "scored" and 0 <= out[1].probability <= 1
    assert out[2].status == "not_applicable" and out[2].risk_level == "Not Applicable"
    assert out[2].probability is None
    assert out[3].status == "rejected" and out[3].rejection == "out_of_bounds:age"
    assert out[4].rejection == "missing:gender"


def test_gender_and_label_codes(spark):
    from vitalframe.functions.clinical import gender_code
    df = spark.createDataFrame([(" Male ",), ("m",), ("F",), ("other",)], "g string")
    assert [r[0] for r in df.select(gender_code("g")).collect()] == [2, 2, 1, 1]
    lab = spark.createDataFrame([("High (>= 240 mg/dL)",), ("nope",)], "c string")
    assert [r[0] for r in lab.select(C.label_code("c", C.CHOLESTEROL_LABELS)).collect()] == [3, None]
    assert spark.range(1).select(F.lit("Yes").alias("x")).select(C.yes_no_code("x")).first()[0] == 1


def test_filters_of_later_stages_do_not_repeat_the_source_formulas(spark):
    from vitalframe.plans import batch
    plan = batch.cleaned(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FLOOR(o_totalprice") == 1
