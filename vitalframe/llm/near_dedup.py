"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents with equal shingle sets are one node. A node's signature has
``COORDS`` MinHash coordinates; a (coordinate, value) pair is a token and the
node is posted under each of its tokens. Two sets of similarity J agree in a
coordinate with probability J, so pairs are looked for that collide in at least
``MATCHES`` tokens: at J = 0.75 a pair misses that with probability below 1e-5,
and every document has many such pairs in a group of copies.

* Prefix: with a node's tokens in order of rarity, two nodes that share MATCHES
  tokens share one of their first COORDS - MATCHES + 1. Only those are posted;
  tokens of one node alone need no list at all.
* Skip: the longer lists behind the prefix are never merged. Whether a pair
  collides often enough is read off both signatures.
* First round: every member of a list meets the list's hub (its node of least
  hash) only, and of its hubs the ``HUBS`` it collides with most are confirmed
  on full sets. That joins most of a group of copies at linear cost.
* Second round, for what the first has not joined: nodes are packed into blocks
  (by component, others by the longest of their lists), lists become lists of
  blocks, and each distinct pair of blocks is one task's work: collisions of all its pairs across
  components are counted as one numpy product, and pairs that reach MATCHES and
  are not yet joined within the task are confirmed on full sets.

So no list is expanded into pairs of documents, no pair is left out, and every
link is confirmed: 100 * intersection >= 75 * union.

Defined cases: null, empty and wordless texts have no shingles and link with
nothing; fewer than five words are one shingle; rows of one doc_id are rows of
their own whose component is found by text; a null doc_id never is a component's
name unless the component has no other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import MaybeIn, free_names, keep, maybe_in, read_table
from .components import components
from .shingles import mix, shingle_set

COORDS, MATCHES = 64, 31
#: Prefix: two nodes with MATCHES common tokens have one in common here.
PREFIX = COORDS - MATCHES + 1
#: Hubs a node is confirmed against in the first round.
HUBS = 2
#: Nodes and shingles of a block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Members of a hub confirmed by one task.
SALT = 512
#: Similarity of a link, as a share of 100.
PERCENT = 75

_RND = np.random.default_rng(20240607)
_A = _RND.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RND.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDS 32-bit MinHash coordinates of a non-empty set."""
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        out = np.minimum(out, mix(shingles[at : at + 4096, None] * _A + _B).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough, on full sets."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    # members of the smaller set found in the larger
    a, b = (a, b) if n <= m else (b, a)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (n + m - both)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n, node, sig)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch, n, node, sig = whole.slice(at, 512), [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                node.append(_node_of(s))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "node", "sig"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sig) -> (token, node): coordinate in the high bits, value in the low ones."""
    coord = np.arange(COORDS, dtype=np.int64) << 32
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDS).astype(np.int64)
            yield pa.record_batch([pa.array((sig + coord).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), COORDS))], names=["token", "node"])


def _node_of(shingles: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "little", signed=True) if len(shingles) else None


def _sets(batches: Iterator[pa.RecordBatch], among: MaybeIn) -> Iterator[pa.RecordBatch]:
    """(place, place, text) -> (node, shingles) of the texts the filter lets through."""
    for batch in batches:
        some = batch.filter(pa.array(among.hits(batch.column(0).to_numpy(), batch.column(1).to_numpy())))
        sets = [x for x in map(shingle_set, some.column(2).to_pylist()) if len(x)]
        yield pa.record_batch([pa.array([_node_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])


def _active_sets(docs: DataFrame, nodes: DataFrame, active: DataFrame) -> DataFrame:
    """(node, shingles): the full sets of active nodes (and of a few others), read again from the texts without shuffling them."""
    among = maybe_in(nodes.join(active, "node", "left_semi").select("first"))
    a, b = among.bits(F.col("doc_id"))
    found = docs.select(a.alias("a"), b.alias("b"), "text").mapInArrow(partial(_sets, among=among), "node long, shingles binary")
    return keep(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "dedup-sets")


def _confirm_star(table: pa.Table) -> pa.Table:
    """A hub's row (hub_row true) and members -> (a, b) links."""
    rows = table.to_pylist()
    hubs = [r for r in rows if r["is_hub"]]
    if not hubs:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    mine = np.frombuffer(hubs[0]["shingles"], np.uint64)
    ok = [r["node"] for r in rows if not r["is_hub"] and linked(mine, np.frombuffer(r["shingles"], np.uint64))]
    return pa.table({"a": pa.array(ok, pa.int64()), "b": pa.array([hubs[0]["node"]] * len(ok), pa.int64())})


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a block -> one row."""
    return pd.DataFrame([{"block": pdf["block"].iloc[0], "nodes": pdf["node"].to_numpy(np.int64).tobytes(), "comps": pdf["comp"].to_numpy(np.int64).tobytes(), "sigs": b"".join(pdf["sig"]),
                          "sizes": np.array([len(s) // 8 for s in pdf["shingles"]], np.int64).tobytes(), "sets": b"".join(pdf["shingles"])}])


def _unpack(r: dict) -> tuple:
    cut = np.cumsum(np.frombuffer(r["sizes"], np.int64))[:-1]
    return (np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["comps"], np.int64), np.frombuffer(r["sigs"], np.uint32).reshape(-1, COORDS), np.split(np.frombuffer(r["sets"], np.uint64), cut))


def block_links(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Links across components between two blocks (or within one), enough to span what they join."""
    (na, ca, sa, xa), (nb, cb, sb, xb) = a, b
    hits = np.zeros((len(na), len(nb)), np.uint8)
    for k in range(COORDS):
        hits += sa[:, k][:, None] == sb[:, k][None, :]
    sizes_a, sizes_b = np.array([len(x) for x in xa]), np.array([len(x) for x in xb])
    fit = 100 * np.minimum(sizes_a[:, None], sizes_b) >= PERCENT * np.maximum(sizes_a[:, None], sizes_b)
    i, j = np.nonzero((hits >= MATCHES) & (ca[:, None] != cb) & fit)
    order = np.argsort(-hits[i, j].astype(np.int64), kind="stable")
    root: dict = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    out = []
    for p, q in zip(i[order].tolist(), j[order].tolist()):
        u, v = find(int(ca[p])), find(int(cb[q]))
        if u != v and linked(xa[p], xb[q]):
            root[u] = v
            out.append((int(na[p]), int(nb[q])))
    return out


def _confirm_blocks(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    found = block_links(_unpack(rows[0]), _unpack(rows[-1])) if rows else []
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def near_duplicates(df: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """(doc_id, n_shingles, node, component_id, kept) of every row; node is null for texts without shingles."""
    docs = df.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))
    slim = keep(docs.mapInArrow(_describe, "doc_id long, n long, node long, sig binary"), "dedup-docs")
    nodes = keep(slim.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.first("sig").alias("sig")), "dedup-nodes")

    # inverted lists: tokens of two nodes or more, each node's rarest ones
    posted = nodes.select("node", "sig").mapInArrow(_postings, "token long, node long")
    common = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    many = posted.join(common, "token")
    mine = Window.partitionBy("node")
    ranked = many.withColumn("rank", F.row_number().over(mine.orderBy("df", "token"))).withColumn("n", F.count("*").over(mine))
    # the COORDS - n tokens of this node alone come first in order of rarity
    lists = keep(ranked.where(F.col("rank") <= F.col("n") - (COORDS - PREFIX)).select("token", "node"), "dedup-lists")
    active = lists.select("node").distinct()
    sets = _active_sets(docs, nodes, active)

    # first round: hubs
    rank = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("hub"))
    hubs = lists.groupBy("token").agg(F.min(rank).alias("top"))
    star = lists.join(hubs, "token").select("node", F.col("top.h").alias("h"), F.col("top.hub").alias("hub")).where("node != hub").distinct()
    bare = nodes.select("node", "sig")
    star = star.join(bare, "node").join(bare.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    star = keep(star.mapInArrow(_collisions, "node long, hub long, h long, hits int").where(F.col("hits") >= MATCHES), "dedup-star")
    best = star.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("hits"), "h", "hub"))).where(F.col("r") <= HUBS).select("node", "hub")
    salts = best.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(SALT)).cast("int").alias("salts"))
    members = best.join(salts, "hub").select("hub", F.pmod(F.xxhash64("node", F.lit(3)), F.col("salts")).cast("int").alias("salt"), "node", F.lit(False).alias("is_hub"))
    heads = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("node"), F.lit(True).alias("is_hub"))
    links = keep(members.unionByName(heads).join(sets, "node").groupBy("hub", "salt").applyInArrow(_confirm_star, "a long, b long"), "dedup-links")
    comp = components(links)

    # second round: blocks of nodes, pairs of blocks that share a list
    one = active.join(comp, "node", "left")
    # nodes of one long list share blocks: alone, or by their hubs, they would be its square in pairs
    theirs = lists.join(one.where("component is null"), "node", "left_semi")
    often = theirs.groupBy("token").agg(F.count("*").alias("k"))
    longest = theirs.join(often, "token").groupBy("node").agg(F.max(F.struct("k", "token")).alias("longest")).select("node", F.col("longest.token").alias("list"))
    grouped = one.join(longest, "node", "left").join(nodes.select("node", "n"), "node")
    grouped = grouped.select("node", "n", F.coalesce("component", "node").alias("comp"), F.col("component").isNotNull().alias("joined"), F.coalesce("component", "list", "node").alias("cluster"))
    count = grouped.groupBy("cluster", "joined").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("parts"))
    block = F.struct("cluster", "joined", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int").alias("part"))
    placed = keep(grouped.join(count, ["cluster", "joined"]).select("node", "comp", block.alias("block")), "dedup-placed")
    at = lists.join(placed, "node").select("token", "block").distinct()
    right = at.select("token", F.col("block").alias("other"))
    # blocks of one component need no second look
    pairs = at.join(right, "token").where((F.col("block") <= F.col("other")) & ~(F.col("block.joined") & F.col("other.joined") & (F.col("block.cluster") == F.col("other.cluster"))))
    pairs = keep(pairs.select("block", "other").distinct().where(~((F.col("block") == F.col("other")) & (F.col("block.joined")))), "dedup-pairs")
    used = pairs.select("block").unionByName(pairs.select(F.col("other").alias("block"))).distinct()
    content = placed.join(used, "block", "left_semi").join(bare, "node").join(sets, "node")
    packed = keep(content.select("block", "node", "comp", "sig", "shingles").groupBy("block").applyInPandas(_pack, "block struct<cluster:long,joined:boolean,part:int>, nodes binary, comps binary, sigs binary, sizes binary, sets binary"), "dedup-blocks")
    ends = pairs.select(F.struct("block", "other").alias("pair"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    tasks = ends.join(packed, "block").select("pair", F.to_json("block").alias("block"), "nodes", "comps", "sigs", "sizes", "sets")
    more = keep(tasks.groupBy("pair").applyInArrow(_confirm_blocks, "a long, b long"), "dedup-more")

    final = components(links.unionByName(more))
    # a component's name is its least doc_id
    named = nodes.join(final, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "first")
    names = named.groupBy("c").agg(F.min("first").alias("component_id"))
    by_node = named.join(names, "c").select("node", "component_id")
    out = slim.select("doc_id", F.col("n").alias("n_shingles"), "node").join(by_node, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", "node", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("component_id").isNull()).alias("kept"))


def _collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, node, h, sig, hub_sig) -> (node, hub, h, hits)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            a, b = (np.frombuffer(b"".join(col[c].to_pylist()), np.uint32).reshape(-1, COORDS) for c in ("sig", "hub_sig"))
            yield pa.record_batch([col["node"], col["hub"], col["h"], pa.array((a == b).sum(axis=1).astype(np.int32))], names=["node", "hub", "h", "hits"])


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return near_duplicates(docs, F.col("doc_id"), F.col("text")).select("doc_id", "n_shingles", "component_id", "kept")


def _with_node(batches: Iterator[pa.RecordBatch], text: int, among: MaybeIn, name: str) -> Iterator[pa.RecordBatch]:
    """Rows followed by two places in the filter -> the rows it lets through, with their node."""
    for batch in batches:
        a, b = (batch.column(batch.num_columns - k).to_numpy() for k in (2, 1))
        some = batch.filter(pa.array(among.hits(a, b)))
        node = [_node_of(shingle_set(t)) for t in some.column(text).to_pylist()]
        yield pa.RecordBatch.from_arrays([*some.columns[:-2], pa.array(node, pa.int64())], names=[*some.schema.names[:-2], name])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document of least doc_id stays.

    Texts without shingles and rows without doc_id all stay. Rows equal in
    doc_id and shingles are one document, of which one row stays. Only rows of
    components of two rows or more (and a filter's few false hits) are shuffled.
    """
    found = keep(near_duplicates(docs, F.col("doc_id"), F.col("text")).where("node is not null and doc_id is not null").select("doc_id", "node", "component_id"), "dedup-found")
    multi = found.groupBy("component_id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "node")).alias("best")).where("n > 1").select("component_id", "best")
    touched = keep(found.join(multi, "component_id").select("doc_id", "node", (F.struct("doc_id", "node") == F.col("best")).alias("stays")), "dedup-touched")
    among = maybe_in(touched.select("doc_id"))
    a, b = among.bits(F.col("doc_id"))
    first, second, node = free_names(docs.columns, "a", "b", "node")
    part = docs.select("*", a.alias(first), b.alias(second)).mapInArrow(
        partial(_with_node, text=docs.columns.index("text"), among=among, name=node), T.StructType([*docs.schema.fields, T.StructField(node, T.LongType())]))
    gone = touched.where("not stays").select("doc_id", F.col("node").alias(node)).distinct()
    part = part.join(gone, ["doc_id", node], "left_anti")
    known = F.col(node).isNotNull() & F.col("doc_id").isNotNull()
    whole = part.where(~known)
    part = part.where(known).dropDuplicates(["doc_id", node])
    return docs.where(~among(F.col("doc_id"))).unionByName(whole.unionByName(part).select(*docs.columns))
