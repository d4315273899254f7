"""Distributed ordered statistics: prefix sums, exact quantiles.

A cumulative window with no ``partitionBy`` runs in one task. Here the order
key is cut into ``num_buckets`` contiguous ranges (boundaries from a range
partitioner over the key; a driver collect of at most ``num_buckets`` numbers).
Then

* inside each (group, bucket) a running window gives the local prefix;
* bucket totals (groups x buckets rows) get their own running window;
* the two are added after an equi-join on (group, bucket), which AQE turns
  into a broadcast when the totals table is small.

Equal order keys always land in the same bucket, so ties stay together.
Callers pre-aggregate to distinct order keys first, so a hot key (even a
third of all rows) is one row here.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_buckets(df: DataFrame) -> int:
    try:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # noqa: BLE001
        n = 200
    return max(8, 2 * n)


def range_bounds(df: DataFrame, order_col: str, num_buckets: int) -> list[float]:
    """Equi-depth boundaries of ``order_col`` (sorted, de-duplicated).

    They are the first keys of a range partitioner's partitions, so no task
    gathers a sketch of everything; the driver gets one number a bucket.
    """
    if num_buckets <= 1:
        return []
    key = df.select(F.col(order_col).cast("double").alias("k")).where("k is not null and not isnan(k)")
    firsts = key.repartitionByRange(num_buckets, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    return sorted({r.k for r in firsts.collect() if not math.isinf(r.k)})[1:]


def with_bucket(df: DataFrame, order_col: str, bounds: list[float],
                out: str = "_bucket") -> DataFrame:
    """Bucket id from the boundaries (JVM-side binary search)."""
    if not bounds:
        return df.withColumn(out, F.lit(0.0))
    # nulls sort first in a window and get the bucket before all others
    tmp = f"{out}_key"
    splits = [-math.inf] + bounds + [math.inf]
    bz = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    found = bz.transform(df.withColumn(tmp, F.col(order_col).cast("double"))).drop(tmp)
    return found.withColumn(out, F.when(F.col(order_col).isNull(), F.lit(-1.0)).otherwise(F.col(out)))


def exclusive_prefix_sums(df: DataFrame, group_cols: list[str], order_cols: list[str],
                          sum_cols: list[str], num_buckets: int | None = None,
                          prefix: str = "before_", materialize: bool = False) -> DataFrame:
    """Add ``before_<c>``: sum of ``c`` over earlier rows of the same group.

    Rows are ordered by ``order_cols`` (the first one is numeric and picks the
    bucket; later ones break ties). Null groups are groups of their own; rows with
    a null order key come first in their group.

    The boundaries and the windows are two passes over ``df``. For a reduced
    input (per-score or per-value counts) pass ``materialize=True``: it is
    written once to the checkpoint folder (lineage cut), so the upstream
    plan runs once instead of twice.
    """
    if materialize:
        from vitalframe.session import checkpoint_root
        checkpoint_root(df.sparkSession)
        df = df.checkpoint(eager=True)
    nb = num_buckets or default_buckets(df)
    key = order_cols[0]
    bounds = range_bounds(df, key, nb)
    b = with_bucket(df, key, bounds)
    parts = group_cols + ["_bucket"]

    local_w = (Window.partitionBy(*parts).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = b.withColumns({f"_loc_{c}": F.coalesce(F.sum(c).over(local_w), F.lit(0))
                           for c in sum_cols})

    totals = b.groupBy(*parts).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    off_w = (Window.partitionBy(*group_cols).orderBy("_bucket")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        *parts,
        *[F.coalesce(F.sum(f"_tot_{c}").over(off_w), F.lit(0)).alias(f"_off_{c}")
          for c in sum_cols])

    # null-safe, so that no row is lost
    right = offsets.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(parts)], *[f"_off_{c}" for c in sum_cols])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(parts)])
    return local.join(right, same).select(
        *df.columns,
        *[(F.col(f"_off_{c}") + F.col(f"_loc_{c}")).alias(f"{prefix}{c}") for c in sum_cols],
    )


def exact_quantiles(long_df: DataFrame, group_col: str, value_col: str,
                    probs: list[float], num_buckets: int | None = None,
                    out_names: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group (numpy / pandas 'linear').

    ``long_df`` has one row per observation; nulls are ignored. The work is
    a count per distinct (group, value), distributed prefix sums and one
    conditional aggregate; no group is ever gathered into one task.
    """
    counts = (long_df.where(F.col(value_col).isNotNull())
              .groupBy(group_col, value_col).agg(F.count(F.lit(1)).alias("_cnt")))
    return quantiles_from_counts(counts, group_col, value_col, probs, num_buckets, out_names)


def quantiles_from_counts(counts: DataFrame, group_col: str, value_col: str,
                          probs: list[float], num_buckets: int | None = None,
                          out_names: list[str] | None = None,
                          materialize: bool = True) -> DataFrame:
    """``exact_quantiles`` from a (group, value, _cnt) table of distinct non-null values.

    Pass ``materialize=False`` when ``counts`` is already checkpointed.
    """
    names = out_names or [f"q{int(round(p * 100))}" for p in probs]
    pre = exclusive_prefix_sums(counts, [group_col], [value_col], ["_cnt"], num_buckets,
                                materialize=materialize)
    # One row per group; the join strategy follows its actual size.
    n = pre.groupBy(group_col).agg(F.sum("_cnt").alias("_n"))
    x = pre.join(n, on=group_col)
    aggs = []
    for p, name in zip(probs, names):
        k = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(k), F.ceil(k)
        start, end = F.col("before__cnt"), F.col("before__cnt") + F.col("_cnt")

        def hit(pos: Column) -> Column:
            return (start <= pos) & (pos < end)

        aggs += [
            F.max(F.when(hit(lo), F.col(value_col).cast("double"))).alias(f"_{name}_lo"),
            F.max(F.when(hit(hi), F.col(value_col).cast("double"))).alias(f"_{name}_hi"),
            F.max(k - lo).alias(f"_{name}_t"),
        ]
    got = x.groupBy(group_col).agg(*aggs)
    return got.select(
        group_col,
        *[(F.col(f"_{nm}_lo") + (F.col(f"_{nm}_hi") - F.col(f"_{nm}_lo")) * F.col(f"_{nm}_t"))
          .alias(nm) for nm in names],
    )
