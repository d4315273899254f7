"""Embedding near-duplicates: int8 tile products with error bounds, exact where it matters.

Vectors of one label are packed into tiles of up to ``TILE`` rows; every pair of
tiles of a label is one row of an equi-join on label and tile pair, so the work
spreads over tasks whatever a label's share. Per tile pair, the unit vectors'
int8 roundings are multiplied; with x = s q + e (scale s, rounding error e),
|x.y - s t q.r| <= |e| |y'| + |f| |x'| + |e| |f| bounds each pair's true product
from the stored norms. Pairs that the bound puts below the threshold are out;
all others are computed in double precision from the original components.

Equal vectors are collapsed to one with a count first, so a vector that a third
of all rows share costs one row. Links come back as (vector, partner) rows for
counting and components; per tile pair, the component step gets a spanning
forest of its links rather than all of them.

Defined cases: rows whose vector is null, empty, zero or has null or non-finite
components, or whose label is null, link with nothing and form their own
component; vectors of different length never link; rows of one id are one node, whatever
their vectors; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read_table
from .components import components

#: Rows of a tile.
TILE = 1024
THRESHOLD = 0.93


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec, label, dim, key, v) rows -> the same with the unit vector's int8 rounding, scale and error norms."""
    for batch in batches:
        q, facts = [], []
        for v in batch.column(4):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max()
            scale = np.abs(x).max() / 127.0
            r = np.rint(x / scale)
            q.append(r.astype(np.int8).tobytes())
            facts.append((scale, float(np.linalg.norm(x - scale * r)), float(scale * np.linalg.norm(r))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q, pa.binary()), *[pa.array([f[i] for f in facts], pa.float64()) for i in range(3)]],
                                         names=[*batch.schema.names, "q", "scale", "err", "norm"])


def upper_bound(a: dict, b: dict) -> np.ndarray:
    """Upper bound of all pairs' cosine from the roundings of two tiles."""
    # int8 products sum exactly in float32 up to 2 ** 24, in float64 beyond
    kind = np.float32 if a["q"].shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (a["q"].astype(kind) @ b["q"].astype(kind).T).astype(np.float64) * np.outer(a["scale"], b["scale"])
    slack = np.outer(a["err"], b["norm"] + b["err"]) + np.outer(a["norm"], b["err"])
    return near + slack * (1 + 1e-9) + 1e-9


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row cosine in double precision; rows are scaled by powers of two first, which rounds nothing."""
    x, y = (np.ldexp(z, -np.frexp(np.abs(z).max(axis=1))[1][:, None]) for z in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _tile(row_ids: bytes, q: bytes, facts: bytes, v: bytes, kind: str) -> dict:
    n = len(row_ids) // 8
    s = np.frombuffer(facts, np.float64).reshape(n, 3)
    return {"vec": np.frombuffer(row_ids, np.int64), "q": np.frombuffer(q, np.int8).reshape(n, -1), "scale": s[:, 0], "err": s[:, 1], "norm": s[:, 2], "v": np.frombuffer(v, kind).reshape(n, -1).astype(np.float64)}


def tile_links(a: dict, b: dict, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i of a, j of b) of all pairs with cosine >= threshold; i < j within one tile."""
    i, j = np.nonzero(upper_bound(a, b) >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    if len(i):
        ok = np.concatenate([exact_cosine(a["v"][i[k : k + 65536]], b["v"][j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)])
        i, j = i[ok], j[ok]
    return i, j


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Indices of links that span the same components."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = find(a), find(b)
        if a != b:
            parent[a] = b
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def _links(batches: Iterator[pa.RecordBatch], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Tile pairs -> per vector its partners' weight (kind 0), and spanning links (kind 1)."""
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            a, b = ({n: cols[f"{n}_{s}"][k].as_py() for n in ("ids", "q", "facts", "v", "w")} for s in "ab")
            wa, wb = np.frombuffer(a.pop("w"), np.int64), np.frombuffer(b.pop("w"), np.int64)
            ta, tb = (_tile(t["ids"], t["q"], t["facts"], t["v"], kind) for t in (a, b))
            same = cols["ta"][k].as_py() == cols["tb"][k].as_py()
            i, j = tile_links(ta, tb, same, threshold)
            if not len(i):
                continue
            # partners by vector
            ca = np.bincount(i, weights=wb[j], minlength=len(wa)).astype(np.int64)
            cb = np.bincount(j, weights=wa[i], minlength=len(wb)).astype(np.int64)
            kept = _forest(i, j + (0 if same else len(wa)), len(wa) + (0 if same else len(wb)))
            ia, ib = np.flatnonzero(ca), np.flatnonzero(cb)
            vec = np.concatenate([ta["vec"][ia], tb["vec"][ib], ta["vec"][i[kept]]])
            other = np.concatenate([ta["vec"][ia], tb["vec"][ib], tb["vec"][j[kept]]])
            n = np.concatenate([ca[ia], cb[ib], np.zeros(len(kept), np.int64)])
            what = np.concatenate([np.zeros(len(ia) + len(ib), np.int32), np.ones(len(kept), np.int32)])
            yield pa.record_batch([pa.array(vec), pa.array(other), pa.array(n), pa.array(what)], names=["vec", "other", "n", "kind"])


def _tiles(pdf: pd.DataFrame, kind: str) -> pd.DataFrame:
    """The rows of a tile -> one row of packed arrays."""
    first = pdf.iloc[0]
    return pd.DataFrame([{
        "label": first["label"], "dim": first["dim"], "tile": first["tile"], "tiles": first["tiles"],
        "ids": pdf["vec"].to_numpy(np.int64).tobytes(), "w": pdf["w"].to_numpy(np.int64).tobytes(), "q": b"".join(pdf["q"]),
        "facts": np.ascontiguousarray(pdf[["scale", "err", "norm"]].to_numpy(np.float64)).tobytes(), "v": np.stack(pdf["v"]).astype(kind).tobytes(),
    }])


def near_vectors(df: DataFrame, vec_id: str, embedding: str, label: str, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    # the exact step needs the components as they came: single precision stays so in the tiles
    kind = "<f4" if df.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"
    rows = keep(df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label")), "vec-rows")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # one row for each distinct vector of a label; -0.0 is 0.0
    plain = rows.where(good).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    distinct = keep(plain.groupBy("label", "v").agg(F.min("vec_id").alias("vec"), F.count("*").alias("w")).withColumn("dim", F.size("v")), "vec-distinct")
    # tiles: hash buckets of a label; as many as its vectors need
    sizes = distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    spread = distinct.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("vec", F.lit(11)), F.col("tiles")).cast("int"))
    packed = (spread.select("vec", "label", "dim", "tile", "v", "w", "tiles").mapInArrow(_pack, "vec long, label string, dim int, tile int, v array<double>, w long, tiles int, q binary, scale double, err double, norm double")
              .groupBy("label", "dim", "tile").applyInPandas(partial(_tiles, kind=kind), "label string, dim int, tile int, tiles int, ids binary, w binary, q binary, facts binary, v binary"))
    packed = keep(packed, "vec-tiles")
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("ids", "q", "facts", "v", "w")]
    # tile t meets every tile u >= t: both are dealt out to the pairs they belong to
    left = packed.select("label", "dim", F.col("tile").alias("ta"), F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("tb"), *side("a"))
    right = packed.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("ta"), F.col("tile").alias("tb"), *side("b"))
    pairs = left.join(right, ["label", "dim", "ta", "tb"])
    found = keep(pairs.select("ta", "tb", *[f"{c}_{s}" for s in "ab" for c in ("ids", "q", "facts", "v", "w")])
                 .mapInArrow(partial(_links, threshold=threshold, kind=kind), "vec long, other long, n long, kind int"), "vec-links")
    counts = found.where("kind = 0").groupBy("vec").agg(F.sum("n").alias("n"))
    comp = components(found.where("kind = 1").select(F.col("vec").alias("a"), F.col("other").alias("b")))
    # a distinct vector's facts, by its least id; its copies link with it and with each other
    facts = distinct.join(counts, "vec", "left").join(comp, distinct["vec"] == comp["node"], "left")
    facts = facts.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
    out = plain.join(facts, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of equal label linked at cosine 0.93 or more."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
