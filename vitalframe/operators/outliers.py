"""Configured-but-optional rules.

D1 / D2 are "fit then filter": the statistics are one small aggregate
(two numbers per column), collected once and turned into literal bounds, so
the filter itself is a plain predicate that Catalyst can push down and that
never joins the data back to its statistics. D7 bands are fixed, tiny
tables, so a band lookup is a generated ``when`` chain instead of a range
join.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.operators.ordered import with_bucket
from vitalframe.operators.selection import quantiles

OUTLIER_COLUMNS = ["age_years", "height", "weight", "ap_hi", "ap_lo"]

# Outlier settings of the model configuration.
IQR_MULTIPLIER = 1.5
ZSCORE_THRESHOLD = 3

# Reference bands of the data / model configuration.
BMI_WHO_BANDS = [("underweight", 0, 18.5), ("normal", 18.5, 25), ("overweight", 25, 30),
                 ("obese_class1", 30, 35), ("obese_class2", 35, 40), ("obese_class3", 40, 100)]
AGE_BANDS = [("young", 0, 40), ("middle", 40, 60), ("senior", 60, 100)]
HEART_RATE_BANDS = [("low", 40, 60), ("normal", 60, 100), ("high", 100, 150)]
BP_BANDS = [  # (name, systolic [lo, hi), diastolic [lo, hi))
    ("normal", (90, 120), (60, 80)),
    ("elevated", (120, 130), (60, 80)),
    ("hypertension_stage1", (130, 140), (80, 90)),
    ("hypertension_stage2", (140, 180), (90, 120)),
    ("hypertensive_crisis", (180, 250), (120, 150)),
]


def iqr_bounds(df: DataFrame, columns: list[str] | None = None,
               multiplier: float = IQR_MULTIPLIER) -> dict[str, tuple[float, float]]:
    """D1 fit: exact Q1 / Q3 per column (linear interpolation) -> [Q1 - k IQR, Q3 + k IQR]."""
    cols = columns or [c for c in OUTLIER_COLUMNS if c in df.columns]
    value = {c: F.col(c).cast("double") for c in cols}
    n = df.agg(*[F.count(F.when(~F.isnan(v), v)).alias(c) for c, v in value.items()]).first().asDict()
    out = {}
    for c, (q1, q3) in quantiles(df, value, n, [0.25, 0.75])[0].items():
        if q1 is not None:
            out[c] = (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
    return out


def zscore_bounds(df: DataFrame, columns: list[str] | None = None,
                  threshold: float = ZSCORE_THRESHOLD) -> dict[str, tuple[float, float]]:
    """D2 fit: mean and population std per column -> |x - mean| / std <= threshold."""
    cols = columns or [c for c in OUTLIER_COLUMNS if c in df.columns]
    row = df.agg(*[x for c in cols for x in (
        F.avg(F.col(c).cast("double")).alias(f"m__{c}"),
        F.stddev_pop(F.col(c).cast("double")).alias(f"s__{c}"))]).first()
    return {c: (row[f"m__{c}"], row[f"s__{c}"]) for c in cols}


def filter_iqr(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """D1 apply: keep rows inside every column's bounds (inclusive)."""
    preds = [F.col(c).between(F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items()]
    return df.where(reduce(lambda a, b: a & b, preds))


def filter_zscore(df: DataFrame, stats: dict[str, tuple[float, float]],
                  threshold: float = ZSCORE_THRESHOLD) -> DataFrame:
    """D2 apply: keep rows with |x - mean| / std <= threshold (zero std keeps all)."""
    preds = []
    for c, (m, s) in stats.items():
        if s:
            preds.append(F.abs(F.col(c) - F.lit(m)) / F.lit(s) <= threshold)
    return df.where(reduce(lambda a, b: a & b, preds, F.lit(True)))


def remove_outliers(df: DataFrame, method: str = "iqr", columns: list[str] | None = None) -> DataFrame:
    """D1 / D2 by name ('iqr' or 'zscore')."""
    if method == "iqr":
        return filter_iqr(df, iqr_bounds(df, columns))
    if method == "zscore":
        return filter_zscore(df, zscore_bounds(df, columns))
    raise ValueError(f"unknown outlier method: {method!r}")


def band(c, bands: list[tuple[str, float, float]]) -> Column:
    """Name of the band with lo <= x < hi (null outside every band)."""
    x = F.col(c) if isinstance(c, str) else c
    e = None
    for name, lo, hi in bands:
        cond = (x >= lo) & (x < hi)
        e = F.when(cond, F.lit(name)) if e is None else e.when(cond, F.lit(name))
    return e


def bp_band(s="ap_hi", d="ap_lo") -> Column:
    """Highest BP band whose systolic or diastolic range holds the reading."""
    s = F.col(s) if isinstance(s, str) else s
    d = F.col(d) if isinstance(d, str) else d
    e = None
    for name, (slo, shi), (dlo, dhi) in reversed(BP_BANDS):
        cond = ((s >= slo) & (s < shi)) | ((d >= dlo) & (d < dhi))
        e = F.when(cond, F.lit(name)) if e is None else e.when(cond, F.lit(name))
    return e


def with_reference_bands(df: DataFrame) -> DataFrame:
    """WHO BMI class, three-way age band and BP band columns."""
    return df.withColumns({
        "bmi_who_class": band("bmi", BMI_WHO_BANDS),
        "age_band": band("age_years", AGE_BANDS),
        "bp_band": bp_band(),
    })


#: Bands of a caller's table at most.
MAX_BANDS = 100_000


def elementary_bands(bands: list[tuple[str, float | None, float | None]]) -> tuple[list[float], dict[int, str]]:
    """Sorted bounds, and the band of every stretch between two of them; stretch k begins at bound k - 1.

    The first band of the list wins where bands overlap; a stretch without a band is a gap.
    """
    bounds = sorted({float(b) for _, lo, hi in bands for b in (lo, hi) if b is not None})
    opens: dict[int, list[int]] = {}
    ends = {}
    for i, (_, lo, hi) in enumerate(bands):
        first = 0 if lo is None else bisect_right(bounds, float(lo))
        ends[i] = len(bounds) + 1 if hi is None else bisect_right(bounds, float(hi))
        if first < ends[i]:
            opens.setdefault(first, []).append(i)
    out, live = {}, []
    for k in range(len(bounds) + 1):
        for i in opens.get(k, []):
            heappush(live, i)
        while live and ends[live[0]] <= k:
            heappop(live)
        if live:
            out[k] = bands[live[0]][0]
    return bounds, out


def with_band(df: DataFrame, column: str, bands: DataFrame, out: str = "band") -> DataFrame:
    """D7 with a caller's table ``bands`` (name, low, high; in order of ``rank`` where it has one): low <= x < high.

    A null bound is open, gaps give null, and of overlapping bands the first wins.
    Bounds are looked up by binary search, then joined by stretch number, so a
    row meets one band however many there are. Null and NaN have no band.
    """
    order = ["rank"] if "rank" in bands.columns else ["low", "high", "name"]
    rows = bands.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(MAX_BANDS + 1).collect()
    if len(rows) > MAX_BANDS:
        raise ValueError(f"more than {MAX_BANDS} bands")
    bounds, stretches = elementary_bands([(r["name"], r["low"], r["high"]) for r in rows])
    at, name = f"{out}__at", f"{out}__name"
    value = F.col(column).cast("double")
    if not bounds:  # no bands, or open ones
        return df.withColumn(out, F.when(value.isNotNull() & ~F.isnan(value), F.lit(stretches.get(0)).cast("string")))
    found = with_bucket(df.withColumn(f"{at}_x", F.when(~F.isnan(value), value)), f"{at}_x", bounds, at)
    table = df.sparkSession.createDataFrame([(float(k), v) for k, v in stretches.items()], f"`{at}` double, `{name}` string")
    # a missing value has a bucket of its own
    joined = found.join(F.broadcast(table), at, "left")
    return joined.select(*[F.col(c) for c in df.columns if c != out], F.col(name).alias(out))
