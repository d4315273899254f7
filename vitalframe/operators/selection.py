"""Exact order statistics by refined histograms: ranks of many columns at once, without a sort.

A pass counts every column's values in BINS bins between its least and greatest
value (bins of the doubles' own order, so no distribution is too uneven), a task
sending one row a filled bin. The driver finds the bin that holds a wanted rank;
the next pass looks into these bins alone. A bin of one value ends the search for
its ranks. A pass narrows a range of the 2 ** 64 doubles by a factor of BINS, so
six passes always suffice and one or two usually do. Nothing is shuffled but
counts: at most BINS rows a task and open bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a range in one pass.
BINS = 2048


def _keys(values: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits)


@dataclass
class Found:
    """What a search knows: values by (column, rank), and the number of distinct values of columns whose bins told it."""
    values: dict[tuple[str, int], float] = field(default_factory=dict)
    distinct: dict[str, int] = field(default_factory=dict)


def _count(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A task's counts, least and greatest values of the bins of all open ranges."""
    ranges, bins = shared.value
    out = {k: (np.zeros(bins, np.int64), np.full(bins, np.inf), np.full(bins, -np.inf)) for k in range(len(ranges))}
    for batch in batches:
        columns = {}
        for k, (column, low, high) in enumerate(ranges):
            if column not in columns:
                v = batch.column(column).drop_null().to_numpy(zero_copy_only=False).astype(float)
                columns[column] = np.sort(v[~np.isnan(v)] + 0.0)
            v = columns[column]
            v = v[np.searchsorted(v, low, "left") : np.searchsorted(v, high, "right")]
            if not len(v):
                continue
            first, last = (int(_keys(np.array([x]))[0]) for x in (low, high))
            # unsigned differences hold the whole range of doubles
            at = ((_keys(v).view(np.uint64) - np.uint64(first % 2**64)) // np.uint64((last - first) // bins + 1)).astype(np.int64)
            start = np.flatnonzero(np.diff(at, prepend=-1))
            end = np.append(start[1:], len(v))
            b, (n, least, most) = at[start], out[k]
            n[b] += end - start
            least[b], most[b] = np.minimum(least[b], v[start]), np.maximum(most[b], v[end - 1])
    for k, (n, least, most) in out.items():
        b = np.flatnonzero(n)
        if len(b):
            yield pa.record_batch([pa.array(np.full(len(b), k, np.int32)), pa.array(b.astype(np.int32)), pa.array(n[b]), pa.array(least[b]), pa.array(most[b])], names=["range", "bin", "n", "least", "most"])


def order_statistics(df: DataFrame, columns: dict[str, Column], ranks: dict[str, list[int]], extremes: dict[str, tuple[float, float]] | None = None) -> Found:
    """Values of the given 0-based ranks of every column; nulls and NaN are left out.

    ``extremes`` spares a pass where the least and greatest values are known. Ranks
    beyond a column's values are not in the result.
    """
    names = list(columns)
    rows = df.select(*[columns[c].cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    if extremes is None:
        clean = [F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")) for i in range(len(names))]
        got = rows.agg(*[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(clean) for f in (F.min, F.max)]).first() if names else []
        extremes = {c: (got[2 * i], got[2 * i + 1]) for i, c in enumerate(names)}
    found, sc = Found(), df.sparkSession.sparkContext
    # (column, least, greatest, values below, wanted ranks)
    open_ = [(c, *extremes[c], 0, sorted(set(ranks.get(c, [])))) for c in names if extremes[c][0] is not None]
    first = True
    while open_:
        shared = sc.broadcast(([(names.index(c), low, high) for c, low, high, _, _ in open_], BINS))
        cells = (rows.mapInArrow(partial(_count, shared=shared), "range int, bin int, n long, least double, most double")
                 .groupBy("range", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect())
        shared.unpersist()
        by_range: dict[int, list] = {}
        for r in cells:
            by_range.setdefault(r.range, []).append(r)
        narrowed = []
        for k, (c, _, _, below, wanted) in enumerate(open_):
            bins = sorted(by_range.get(k, []), key=lambda r: r.bin)
            if first and all(r.least == r.most for r in bins):
                found.distinct[c] = len(bins)
            for r in bins:
                here = [w for w in wanted if below <= w < below + r.n]
                if here and r.least == r.most:
                    found.values.update({(c, w): r.least for w in here})
                elif here:
                    narrowed.append((c, r.least, r.most, below, here))
                below += r.n
        open_, first = narrowed, False
    return found


def quantiles(df: DataFrame, columns: dict[str, Column], counts: dict[str, int], probs: list[float], extremes: dict[str, tuple[float, float]] | None = None) -> tuple[dict[str, list[float | None]], Found]:
    """Exact quantiles with linear interpolation of columns with known numbers of values."""
    places = {c: [(n - 1) * p for p in probs] for c, n in counts.items() if n}
    found = order_statistics(df, columns, {c: [int(f(k)) for k in v for f in (np.floor, np.ceil)] for c, v in places.items()}, extremes)
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    for c, v in places.items():
        ends = [(found.values[c, int(np.floor(k))], found.values[c, int(np.ceil(k))], k - np.floor(k)) for k in v]
        out[c] = [float(a + (b - a) * t) if a != b else float(a) for a, b, t in ends]
    return out, found
