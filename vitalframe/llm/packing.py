"""Packing documents into sequences: cutting stock by column generation.

Every whole run of CAPACITY ids of a document is a sequence of its own; what is
left (the remainder, shorter than CAPACITY) is an item. Items are counted by
length, and a linear program over patterns (multisets of lengths that fill a
sequence) covers the counts with the fewest ids in items that must be cut. Its
columns are generated: a knapsack over the dual prices of the lengths finds the
patterns worth adding. The driver sees the histogram only, at most CAPACITY
numbers, whatever the size of the corpus.

The solution is rounded to whole copies. Items are ranked within their length,
and ranges of ranks go to the copies of the patterns. Items beyond those (lengths
without partners, the rounding's rest) are laid end to end in order of length
and cut at multiples of CAPACITY; the last sequence of them is cut into powers of
two. So nothing is padded, and the better the patterns fit the lengths, the fewer
items are cut.

Defined cases: null and empty texts are the end id alone; repeated rows are
items of their own; texts of any length are encoded whole; a null doc_id is kept;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, maybe_in, read_table

CAPACITY = 1024
END_ID = 0
#: Documents of a ranking bucket, about.
BUCKET_ROWS = 65536
#: The program ends when a pricing lowers the ids left to be cut by less than this share of all ids.
GAP = 2e-3
#: Pre-tokens a worker remembers while it encodes.
MEMORY = 300_000


# ------------------------------------------------------------------ the program

def _knapsacks(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each total, the dearest multiset of lengths with that sum: its price, and one of its lengths (-1: none)."""
    best, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        worth = best[c - lengths[: fit[c]]] + price[: fit[c]]
        k = int(np.argmax(worth))
        best[c], last[c] = worth[k], k if worth[k] > -np.inf else -1
    return best, last


def _pattern(total: int, last: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    use = np.zeros(len(lengths))
    while total:
        use[last[total]] += 1
        total -= int(lengths[last[total]])
    return use


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns that fill a sequence (a row each, columns as ``lengths``, ascending) and how often each is used, fractions allowed.

    The program: cover every count exactly, by patterns at no cost or by cutting
    an item at a cost of its length. Revised simplex; it starts with all items
    cut. A pricing finds the best pattern through every length at once; at first it
    prefers patterns of few items, which leave more combinations for the rounding.
    """
    m, counts = len(lengths), counts.astype(float)
    use, inverse, x = np.zeros((m, m)), np.eye(m), counts.copy()
    basis, cost = np.eye(m), lengths.astype(float)
    ids, pivots, least, few = float(lengths @ counts), 0, 1e-6 * capacity, 1e-2 * capacity
    noise = np.random.default_rng(11).random(m) * 1e-4 * capacity
    price = cost @ inverse
    while True:
        before = cost @ x
        best, last = _knapsacks(price - few - (noise if few else 0), lengths, capacity)
        through = [(price[k] + best[capacity - n], k, capacity - n) for k, n in enumerate(lengths.tolist()) if best[capacity - n] > -np.inf]
        for worth, k, rest in sorted(through, reverse=True):
            column = _pattern(rest, last, lengths)
            column[k] += 1
            if price @ column <= least:
                continue
            way = inverse @ column
            limit = np.full(m, np.inf)
            np.divide(x, way, out=limit, where=way > 1e-9)
            out = int(np.argmin(limit))
            step = limit[out]
            x -= step * way
            x[out] = step
            np.maximum(x, 0, out=x)
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
            use[out], basis[out], cost[out] = column, column, 0
            price = cost @ inverse
            pivots += 1
            if pivots % 500 == 0:  # rounding errors gather in the inverse
                inverse = np.linalg.inv(basis.T)
                x, price = np.maximum(inverse @ counts, 0), cost @ inverse
        if cost @ x >= before - ids * gap:
            if not few:
                return use, x
            few = few / 10 if few > 1e-5 * capacity else 0


def rounded(use: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole copies of the patterns within the counts: the whole parts, then one more by largest fraction while items last."""
    x = np.where(use.any(1), x, 0)  # without the items that are cut
    copies = np.floor(x + 1e-9).astype(np.int64)
    left = counts - (copies @ use).astype(np.int64)
    while (left < 0).any():  # a whole part too many by rounding errors
        at = int(np.argmax((use[:, left < 0].sum(1) > 0) & (copies > 0)))
        copies[at] -= 1
        left += use[at].astype(np.int64)
    for p in np.argsort(-(x - copies), kind="stable").tolist():
        need = use[p].astype(np.int64)
        if need.any() and (x[p] - copies[p]) > 1e-6 and (need <= left).all():
            copies[p] += 1
            left -= need
    return copies, left


class Plan:
    """Where every item goes, by its length and rank: whole to a copy of a pattern, or to the ids that are cut."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY):
        use, x = solve(lengths, counts, capacity) if len(lengths) else (np.zeros((0, 0)), np.zeros(0))
        copies, left = rounded(use, x, counts) if len(lengths) else (np.zeros(0, np.int64), counts)
        taken, rows, self.sequences = np.zeros(capacity, np.int64), [], 0
        for p in np.flatnonzero(copies).tolist():
            offset = 0
            for k in np.flatnonzero(use[p]).tolist():
                size, of = int(lengths[k]), int(use[p, k])
                rows.append((size, int(taken[size]), of, self.sequences, offset))
                taken[size] += of * copies[p]
                offset += of * size
            self.sequences += int(copies[p])
        rows.sort()
        self.size, self.first, self.of, self.base, self.offset = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        self.taken = taken
        rest = np.zeros(capacity, np.int64)
        rest[lengths] = left * lengths
        #: place of the first cut item of each length in the row of all ids to be cut
        self.at = np.cumsum(rest) - rest
        total = int(rest.sum())
        self.full, tail = total // capacity, total % capacity
        parts = [1 << b for b in range(capacity.bit_length(), -1, -1) if tail >> b & 1]
        #: ends of the sequences after the full ones
        self.ends = self.full * capacity + np.cumsum(np.array(parts, np.int64))
        self.capacity = capacity
        self.first_whole_run = self.sequences + self.full + len(parts)

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and offset of the items placed whole (-1: not), and the place among the ids to be cut of the others (-1: none)."""
        whole = (rank < self.taken[size]) & (size > 0)
        sequence, offset, place = (np.full(len(size), -1) for _ in range(3))
        big = np.int64(1) << 40
        k = np.searchsorted(self.size * big + self.first, size[whole] * big + rank[whole], "right") - 1
        copy, slot = np.divmod(rank[whole] - self.first[k], self.of[k]) if len(k) else (k, k)
        sequence[whole], offset[whole] = self.base[k] + copy, self.offset[k] + slot * size[whole]
        cut = ~whole & (size > 0)
        place[cut] = self.at[size[cut]] + (rank[cut] - self.taken[size[cut]]) * size[cut]
        return sequence, offset, place

    def cuts(self, place: int, size: int) -> list[tuple[int, int, int, int]]:
        """(start in the item, length, sequence, offset) of the pieces of an item to be cut."""
        out, at = [], place
        while at < place + size:
            if at < self.full * self.capacity:
                k, first = at // self.capacity, at // self.capacity * self.capacity
                end = first + self.capacity
            else:
                j = int(np.searchsorted(self.ends, at, "right"))
                k, first, end = self.full + j, int(self.ends[j - 1]) if j else self.full * self.capacity, int(self.ends[j])
            stop = min(end, place + size)
            out.append((at - place, stop - at, self.sequences + k, at - first))
            at = stop
        return out


# ------------------------------------------------------------------ documents

TOKENS = "doc_id long, n long, runs array<long>, size long, crc long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Checksums of a document's whole runs, and its remainder."""
    from .encoders import encoder
    from .encoders import vocabulary as find

    enc, end, run = encoder(find(vocabulary), MEMORY), int(end_id).to_bytes(4, "little"), 4 * capacity
    for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = memoryview(enc.encode(text or "") + end)
            cut = len(ids) // run * run
            out.append((doc_id, len(ids) // 4, [zlib.crc32(ids[k : k + run]) for k in range(0, cut, run)], (len(ids) - cut) // 4, zlib.crc32(ids[cut:]), bytes(ids[cut:])))
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "n", "runs", "size", "crc", "ids"])


def tokens(df: DataFrame, doc_id: Column, text: Column, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(uid, doc_id, n, runs, size, crc, ids): every document's length, checksums of its whole runs, and remainder; written."""
    rows = df.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))
    found = rows.mapInArrow(partial(_encode, vocabulary=vocabulary, end_id=end_id, capacity=capacity), TOKENS)
    return keep(found.select(F.monotonically_increasing_id().alias("uid"), "*"), "packing-tokens")


def _place(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = shared.value.place(batch.column("size").to_numpy(), batch.column("rank").to_numpy())
        yield pa.record_batch([*(batch.column(c) for c in ("uid", "doc_id", "n", "runs", "size", "crc", "run")), *map(pa.array, found)],
                              names=["uid", "doc_id", "n", "runs", "size", "crc", "run", "sequence", "offset", "place"])


def _cut(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            ids = memoryview(r["ids"])
            for start, length, sequence, offset in shared.value.cuts(r["place"], r["size"]):
                out.append((r["doc_id"], r["n"] - r["size"] + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), r["n"], sequence, offset))
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in PIECES.split(", ")])


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the documents of ``tokens``, a row each (see PIECES)."""
    sc = found.sparkSession.sparkContext
    histogram = sorted((r["size"], r["k"]) for r in found.where("size > 0").groupBy("size").agg(F.count("*").alias("k")).collect())  # fewer than capacity rows
    plan = Plan(np.array([s for s, _ in histogram], np.int64), np.array([k for _, k in histogram], np.int64), capacity)
    shared = sc.broadcast(plan)

    buckets = found.count() // BUCKET_ROWS + 64
    slim = found.select("uid", "doc_id", "n", "runs", "size", "crc", F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("bucket")).repartition("bucket")
    earlier = (Window.unboundedPreceding, -1)
    per = keep(slim.groupBy("bucket", "size").agg(F.count("*").alias("k"), F.sum(F.size("runs").cast("long")).alias("runs_k")), "packing-counts")
    zero = F.lit(0).cast("long")
    # a row a bucket and length, and a row a bucket
    items = per.select("bucket", "size", F.coalesce(F.sum("k").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(*earlier)), zero).alias("items_before"))
    runs = per.groupBy("bucket").agg(F.sum("runs_k").alias("k")).select("bucket", F.coalesce(F.sum("k").over(Window.orderBy("bucket").rowsBetween(*earlier)), zero).alias("runs_before"))
    inside = slim.select("*", (F.row_number().over(Window.partitionBy("bucket", "size").orderBy("uid")) - 1).alias("i"),
                         F.coalesce(F.sum(F.size("runs").cast("long")).over(Window.partitionBy("bucket").orderBy("uid").rowsBetween(*earlier)), zero).alias("j"))
    ranked = inside.join(items, ["bucket", "size"]).join(runs, "bucket").select(
        "uid", "doc_id", "n", "runs", "size", "crc", (F.col("i") + F.col("items_before")).alias("rank"), (F.col("j") + F.col("runs_before")).alias("run"))
    placed = keep(ranked.mapInArrow(partial(_place, shared=shared), "uid long, doc_id long, n long, runs array<long>, size long, crc long, run long, sequence long, offset long, place long"), "packing-places")

    out = [c.split()[0] for c in PIECES.split(", ")]
    begin = (F.col("n") - F.col("size")).alias("start")
    whole = placed.where("sequence >= 0").select("doc_id", begin, F.col("size").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")
    full = placed.select("doc_id", "n", "run", F.posexplode("runs").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"),
        (F.col("run") + F.col("k") + plan.first_whole_run).alias("sequence_id"), zero.alias("offset"))
    cut = placed.where("place >= 0").select("uid", "place")
    # only remainders that are cut are moved
    held = found.select("uid", "doc_id", "n", "size", "ids").where(maybe_in(cut.select("uid"))(F.col("uid")))
    parts = held.join(cut, "uid").select("doc_id", "n", "size", "ids", "place").mapInArrow(partial(_cut, shared=shared), PIECES)
    return whole.select(*out).unionByName(full.select(*out)).unionByName(parts.select(*out))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 ids."""
    docs = read_table(spark, sf_dir, "documents")
    return pack(tokens(docs, F.col("doc_id"), F.col("text")))
