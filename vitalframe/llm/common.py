"""Helpers shared by the operators of this subpackage.

Every operator first projects its input to the columns it needs, under names of
its own, so extra or clashing columns of the caller never reach a plan. Stages,
which carry all columns of the caller, take names that these do not have
(``free_names``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.session import scratch_dir

#: A word, wherever words are counted or shingled: a run of anything but space and tab..carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The complement, as a split pattern.
GAP = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch. Rows here are whole documents: the usual 10,000 of them fill memory on both sides of the pipe.
BATCH_ROWS = 512
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS (a smaller setting stays)."""
    if not 0 < int(spark.conf.get(_BATCH_SETTING, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test folder, by a path that only Spark needs to open."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    This cuts the lineage: an executor lost later costs a re-read, not a re-run.
    """
    small_batches(df.sparkSession)
    path = scratch_dir(df.sparkSession, name)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores added until no column has it (upper and lower case are one)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null, as long."""
    words = F.split(text, GAP)
    # a leading or trailing gap leaves an empty piece at that end
    edge = (F.element_at(words, 1) == "").cast("long") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("long")
    return F.coalesce(F.when(text != "", F.size(words).cast("long") - edge), F.lit(0).cast("long"))


def bounded(df: DataFrame, most: int, what: str) -> list:
    """Collect a table of statistics that has a documented size bound; raise beyond it."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


#: Bits of a filter; its size does not follow the data (it lets more through when it fills up).
FILTER_BITS = 1 << 26


class MaybeIn:
    """A Bloom filter of ids: true for all of them and for few others."""

    def __init__(self, shared):
        self.shared = shared

    @staticmethod
    def bits(c: Column) -> list[Column]:
        """The places of an id in the filter, two integer columns."""
        return [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(FILTER_BITS)).cast("int") for k in (1, 2)]

    def hits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of places are both set; for use inside a task."""
        table = self.shared.value
        return np.logical_and.reduce([(table[x >> 5] >> (x & 31).astype(np.uint32)) & 1 for x in (a, b)]).astype(bool)

    def __call__(self, c: Column) -> Column:
        """The filter as a predicate."""

        def hit(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(self.hits(a.to_numpy(), b.to_numpy()))

        return F.pandas_udf(hit, "boolean")(*self.bits(c))


def maybe_in(ids: DataFrame) -> MaybeIn:
    """The filter of the one column of ``ids``. Rows that it rejects need not be shuffled to a join with ``ids``."""
    set_bits = ids.select(F.explode(F.array(*MaybeIn.bits(F.col(ids.columns[0])))).alias("bit"))
    words = set_bits.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pmod(bit, 32))")).alias("bits"))
    got = words.toArrow()  # at most FILTER_BITS / 32 rows
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return MaybeIn(ids.sparkSession.sparkContext.broadcast(table))
