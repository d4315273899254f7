"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Every 5-word shingle is hashed once: the high bits choose one of ``BINS`` bins,
which keeps the least hash. An empty bin copies the first filled one in a fixed
pseudo-random sequence of its own, the same for all documents. Of every bin the
``BITS`` low-order bits are stored, packed, as hex. Two fingerprints agree in a
share of bins M; equal bits by chance are corrected for: (M - c) / (1 - c) with
c = 2 ** -BITS, within 0 to 1.

Defined cases: null counts as empty text; a text without words has the empty
fingerprint, like another empty one (1.0) and unlike any other (0.0); repeated
rows and equal doc_ids are ordered by the hash of their text; an empty table
gives no rows; a table's only document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .shingles import mix, shingle_hashes

#: Bins, and stored bits of each.
BINS = 512
BITS = 4
#: Attempts of the densification looked up at once.
STEP = 64


@lru_cache(maxsize=4)
def _attempts(bins: int, block: int) -> np.ndarray:
    """STEP x bins: where an empty bin looks in the attempts of a block."""
    attempt, at = np.meshgrid(np.arange(block * STEP, (block + 1) * STEP, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    return (mix(attempt * np.uint64(bins) + at + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)


def bin_minima(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Least hash of every bin, empty bins filled; needs at least one hash."""
    shift = np.uint64(64 - (bins - 1).bit_length())
    ordered = np.sort(hashes)
    at, first = np.unique((ordered >> shift).astype(np.int64), return_index=True)
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[at], filled[at] = ordered[first], True
    if len(at) == 1:
        return np.full(bins, ordered[0], np.uint64)
    empty, block = np.flatnonzero(~filled), 0
    while len(empty):
        # early blocks are asked for by every text; a late one only by texts of very few shingles
        look = (_attempts(bins, block) if block < 2 else _attempts.__wrapped__(bins, block))[:, empty]
        found = filled[look]
        hit = found.any(axis=0)
        donor = look[found.argmax(axis=0), np.arange(len(empty))]
        out[empty[hit]] = out[donor[hit]]
        empty, block = empty[~hit], block + 1
    return out


def fingerprint(text: str | None, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    """Low-order bits of every bin; None for a text without words."""
    hashes = shingle_hashes(text)
    return (bin_minima(hashes, bins) & np.uint64((1 << bits) - 1)).astype(np.uint8) if len(hashes) else None


def packed(low: np.ndarray | None, bits: int = BITS) -> str:
    """Hex of the bits of all bins in order."""
    return "" if low is None else np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of two texts' shingles."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (np.mean(a == b) - chance) / (1 - chance))))


def _fingerprints(batches: Iterator[pa.RecordBatch], bins: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [packed(fingerprint(t, bins, bits), bits) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(df: DataFrame, doc_id: Column, text: Column, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint) of every row, without a shuffle."""
    return df.select(doc_id.cast("long").alias("doc_id"), text.alias("text")).mapInArrow(partial(_fingerprints, bins=bins, bits=bits), "doc_id long, fingerprint string")


def with_next(df: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """Rows (bucket, doc_id, halo, tie, text), partitioned by bucket and sorted: the next row of a bucket is the next document.

    Buckets are ranges of doc_id as a range partitioner draws them over the ids
    alone; the first document of a bucket is repeated (halo) at the end of the
    one before, the first of all at the end of the last.
    """
    spark = df.sparkSession
    rows = df.select(doc_id.cast("long").alias("doc_id"), F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)).cast("long")).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    # more buckets than partitions, so that hashing buckets to partitions evens out
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("key").repartitionByRange(n, "key")
    firsts = sorted({r.first for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first")).collect()})
    if not firsts:
        return rows.select(F.lit(0).alias("bucket"), "doc_id", F.lit(0).alias("halo"), F.lit(0).cast("long").alias("tie"), "text")
    # the last first <= key: among block leaders, then within the block
    width = max(1, int(len(firsts) ** 0.5))
    blocks = [firsts[i : i + width] for i in range(0, len(firsts), width)]
    leaders = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    nested = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks])
    key = F.col("key")
    located = rows.withColumn("_blk", F.size(F.filter(leaders, lambda x: x <= key)))
    located = located.withColumn("bucket", (F.col("_blk") - 1) * width + F.size(F.filter(F.element_at(nested, F.col("_blk")), lambda x: x <= key)) - 1)
    starts = F.element_at(nested, F.col("_blk"))[F.col("bucket") % width] == key
    halo = F.pmod(F.col("bucket") - 1, F.lit(len(firsts)))
    own = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("halo"))
    again = F.struct(halo.cast("int").alias("bucket"), F.lit(1).alias("halo"))
    spread = located.select("doc_id", "key", "text", F.explode(F.when(starts, F.array(own, again)).otherwise(F.array(own))).alias("to"))
    # the wrapped first document sorts after all others of the last bucket by its halo flag
    return (spread.select("to.bucket", "to.halo", "doc_id", "key", F.xxhash64("text").alias("tie"), "text")
            .repartition(max(1, n // 4), "bucket").sortWithinPartitions("bucket", "halo", "key", "tie").select("bucket", "doc_id", "halo", "tie", "text"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in bucket order -> digests of each document with its next one."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in batches:
        out = []
        for bucket, doc, halo, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if halo and (held is None or held[0] != bucket):
                continue  # a second halo row: its bucket is done
            low = fingerprint(text)
            if held is not None and held[0] == bucket:
                _, d, t, f = held
                k = len(t) // 4
                edited = t[: len(t) - k] + text[:k]
                g = fingerprint(edited)
                out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), packed(f), packed(g), likeness(f, g), likeness(f, low)))
            held = None if halo else (bucket, doc, text, low)
        yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last quarter replaced by the next document's start."""
    docs = read_table(spark, sf_dir, "documents")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, F.col("doc_id"), F.col("text")).mapInArrow(_edited, schema)
