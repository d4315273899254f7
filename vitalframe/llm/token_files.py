"""Token-id files: ORC with integer run-length encoding, row indexes and Bloom filters.

A row is a document: ``doc_id``, ``tie`` (hash of its text, orders repeated
ids), ``n_tokens`` and the list of its ``ids``; ORC stores each integer column
run-length encoded (bit-packed where ids do not repeat). Files are ranges of
ascending doc_id and sorted inside, so the row index and stripe statistics of
doc_id prune range reads, its Bloom filter prunes point reads, and every stripe
can be read by a task of its own.

Defined cases: null and empty texts hold only the end id; repeated doc_ids
follow each other, ordered by the hash of their text; a null doc_id sorts first;
an empty table leaves files without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from vitalframe.session import scratch_dir

from .common import keep, read_table

#: ORC writer settings; ids are dense, so a fast codec is enough.
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000",
               "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "compression": "snappy"}
SCHEMA = "doc_id long, tie long, n_tokens long, ids array<int>"
END_ID = 0
#: Pre-tokens a worker remembers while it encodes.
MEMORY = 1_000_000


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from .encoders import encoder
    from .encoders import vocabulary as find

    import numpy as np

    enc = encoder(find(vocabulary), MEMORY)
    end = int(end_id).to_bytes(4, "little")
    for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
        parts = [enc.encode(t or "") + end for t in batch.column(2).to_pylist()]
        counts = np.fromiter((len(p) // 4 for p in parts), dtype=np.int64, count=len(parts))
        offsets = np.zeros(len(parts) + 1, dtype=np.int32)
        np.cumsum(counts, out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts), ids], names=["doc_id", "tie", "n_tokens", "ids"])


def write_tokens(df: DataFrame, doc_id: Column, text: Column, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID) -> None:
    """Encode every row and write the files of ``path``."""
    body = F.coalesce(text, F.lit(""))
    ordered = (df.select(doc_id.cast("long").alias("doc_id"), F.xxhash64(body).alias("tie"), body.alias("text"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie"))
    tokens = ordered.mapInArrow(partial(_encode, vocabulary=vocabulary, end_id=end_id), SCHEMA)
    tokens.write.mode("overwrite").options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        flat, at = memoryview(lists.values.buffers()[1] or b""), lists.offsets.to_numpy()
        base = lists.values.offset
        crc = [zlib.crc32(flat[4 * (base + a) : 4 * (base + b)]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(crc, pa.int64())],
                              names=["file", "doc_id", "tie", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files.

    ``start`` is the number of ids of all documents before it: a sum over the
    files ahead (one row a file) plus a running sum within the file.
    """
    found = read_tokens(spark, path).select(F.input_file_name().alias("file"), "doc_id", "tie", F.size("ids").cast("long").alias("n_tokens"), "ids")
    slim = keep(found.mapInArrow(_digest, "file string, doc_id long, tie long, n_tokens long, ids_crc32 long"), "token-index")
    files = slim.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min(F.struct("doc_id", "tie")).alias("least"))
    # one row a file
    ahead = files.withColumn("ahead", F.sum("n").over(Window.orderBy("least", "file")) - F.col("n")).select("file", "ahead")
    inside = Window.partitionBy("file").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return (slim.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ahead, "file")
            .select("doc_id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as ORC and read back."""
    path = scratch_dir(spark, "token-files")
    write_tokens(read_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), path)
    return token_index(spark, path)
