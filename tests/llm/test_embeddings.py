"""Components and embedding links against brute force."""

import random

import numpy as np
import pytest

from vitalframe.llm import embedding_dedup as ed
from vitalframe.llm.components import components

SF = "/root/testdata/sf0.001"


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)] + [(99, i) for i in range(50, 80)],
                                   [(random.Random(i).randrange(300), random.Random(i + 999).randrange(300)) for i in range(200)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [(a, b) for a, b in edges if a != b]
    assert got == union_find({n for e in edges for n in e}, edges)


def brute(rows, threshold=0.93):
    """rows: (id, vector, label) with distinct ids."""
    good = {i: (np.array(v, float), lab) for i, v, lab in rows
            if lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = []
    ids = sorted(good)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            (x, a), (y, b) = good[i], good[j]
            if a == b and len(x) == len(y) and (x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links.append((i, j))
    comp = union_find([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


def test_bound_holds_for_all_pairs():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 16)) * rnd.uniform(0.001, 1000, size=(200, 1)) * rnd.choice([1, 1, 0.001], size=(200, 16))
    import pyarrow as pa
    batch = pa.record_batch([pa.array(range(200)), pa.array(["a"] * 200), pa.array([16] * 200), pa.array([0] * 200), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["vec", "label", "dim", "tile", "v"])
    out = next(ed._pack(iter([batch])))
    col = {n: out.column(i) for i, n in enumerate(out.schema.names)}
    t = {"q": np.stack([np.frombuffer(q, np.int8) for q in col["q"].to_pylist()]), **{k: col[k].to_numpy() for k in ("scale", "err", "norm")}}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    bound = ed.upper_bound(t, t)
    assert (bound >= u @ u.T).all() and (bound - u @ u.T).mean() < 0.1


@pytest.mark.parametrize("tile", [8, 1024])
def test_small_table_with_odd_rows(spark, tile):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rnd.normal(size=8) * 0.12).tolist(), ["a", "b", None][(i % 24) % 3 if i % 7 == 0 else 0]) for i in range(90)]
    rows += [(100 + i, base[0].tolist(), "a") for i in range(15)]
    rows += [(200, None, "a"), (201, [], "a"), (202, [0.0] * 8, "a"), (203, [float("nan")] * 8, "a"), (204, [1.0, None] * 4, "a"), (205, [float("inf")] * 8, "a"), (206, [1.0, 2.0], "a"), (207, [2.0, 4.0], "a"), (208, [-0.0, 4.0], "b"), (209, [0.0, 4.0], "b"), (210, [1e-200] * 8, "a"), (211, [1e200] * 8, "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label string, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_vectors(df, "vec_id", "embedding", "label", tile=tile).collect()}
    safe = [r if r[0] not in (210, 211) else (r[0], [1.0] * 8, r[2]) for r in rows]
    assert got == brute(safe)


def test_op9_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.op9_embedding_dedup(spark, SF).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert ed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label").count() == 0
