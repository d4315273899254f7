"""Patient table sources.

``patients_from_orders`` is the deterministic patient view over the driver's
``orders`` table (FIXTURES.md §7): one patient row per order plus one exact
copy of every 150th order, with planted defects. It only shapes rows into
the raw patient schema; no pipeline stage relies on how they were made.
It is a narrow, per-row projection (no shuffle) so it scales with ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.schema import RAW_COLUMNS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _patient_columns(id_col, h) -> list:
    def b(expr):
        return expr.cast("bigint")

    flag = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    weight = (
        F.when(id_col % 211 == 0, F.lit(None)).otherwise(38 + (h * 53) % 165).cast("double")
        + (h % 10).cast("double") / 10
    )
    return [
        id_col.alias("id"),
        b(10200 + (h * 7919) % 16200).alias("age"),
        b(F.when(id_col % 97 == 0, F.lit(3)).otherwise(1 + h % 2)).alias("gender"),
        b(135 + (h * 37) % 80).alias("height"),
        weight.alias("weight"),
        b(85 + (h * 61) % 125).alias("ap_hi"),
        b(55 + (h * 67) % 80).alias("ap_lo"),
        b(1 + h % 3).alias("cholesterol"),
        b(1 + ((h * 11) % 7) % 3).alias("gluc"),
        flag((h * 13) % 10 < 2).alias("smoke"),
        flag((h * 17) % 20 < 1).alias("alco"),
        flag((h * 19) % 10 < 8).alias("active"),
        flag((h * 61) % 125 + (h * 41) % 80 > 100).alias("cardio"),
    ]


def patients_from_orders(orders: DataFrame) -> DataFrame:
    """Raw patient rows (13 columns) derived per order; see module docstring."""
    keyed = orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") * 7
         + F.floor(F.col("o_totalprice")).cast("bigint") % 9973).alias("h"),
    )
    # Every 150th order appears twice: one scan, a bounded explode (1 or 2 rows
    # per order) instead of a second scan of orders for the copies. The whole row
    # is exploded, so filters of later stages read its finished columns: moved below
    # them they would repeat every formula, in a method too large for the JVM to compile.
    row = F.struct(*_patient_columns(F.col("id"), F.col("h")))
    copies = F.when(F.col("id") % 150 == 0, F.lit(2)).otherwise(F.lit(1))
    out = keyed.select(F.explode(F.array_repeat(row, copies)).alias("row")).select("row.*")
    return out.select(*RAW_COLUMNS)


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw patient table for a scale-factor folder."""
    return patients_from_orders(read_table(spark, sf_dir, "orders"))
