"""K-d tree sharding: near equal bytes a shard, groups of equal texts unbroken.

A point of the tree is a group (all rows with one text); its weight is the sum
of its rows' bytes and its coordinates are metadata of the group. A node is
split at the weighted median of its widest dimension (range within the node
over range of the table). The medians of all nodes of a level are found
together: each pass is one aggregate of bytes into bins, whose result (nodes x
``BINS`` rows) goes to the driver, and the bin that holds the median is refined
until it is one group or a sliver of the target. Ties of a coordinate are
ordered by the group's hash, so a common value can be cut between groups.

Groups that alone exceed their share of what is left get a leaf of their own
first; at most ``shards`` such groups can exist. Everything runs on DataFrame
functions; rows never reach the driver.

Defined cases: null text counts as empty text; null or NaN metadata sorts below
every value; repeated rows are rows of their own; an empty table gives no rows;
columns not named are ignored. Fewer groups than shards leave shards empty.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import keep, read_table

#: Bins of a histogram pass.
BINS = 512
#: A bin that holds less than this share of a leaf's target is not refined further.
SLIVER = 0.001
#: Groups with at least 1 / HOT of all rows are joined by broadcast: there are HOT of them at most.
HOT = 200
#: Buckets within a shard for numbering rows.
SLOT_BUCKETS = 256


@dataclass
class Node:
    """A box of the tree: the shards ``first`` to ``first + leaves - 1`` come of it."""

    first: int
    leaves: int
    bytes: float = 0.0
    span: list | None = None  # (least, greatest) by coordinate, None without groups
    # search state: coordinate, its open interval, bytes below it, and a value fixed before (coordinate, value)
    at: int = 0
    lo: float = 0.0
    hi: float = 0.0
    below: float = 0.0
    fixed_at: int | None = None
    fixed: float | None = None


#: A node's search state and cut as rows: plans stay the same from pass to pass, only these rows change.
_PARAMS = "node int, at int, lo double, hi double, fixed_at int, fixed double"
_CUTS = "node int, at int, value double, closed boolean, fixed_at int, fixed double, left_id int, right_id int"


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table, by way of a JSON literal: no Python and no RDD takes part."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ':') for c in schema.split(', '))}>>")).alias("r")).select("r.*")


def _measure(level: DataFrame, nodes: dict[int, Node], width: int) -> None:
    """Bytes and coordinate ranges of every node, in one pass."""
    ends = [f(F.element_at("v", i + 1)).alias(f"{n}{i}") for i in range(width) for n, f in (("lo", F.min), ("hi", F.max))]
    for r in level.groupBy("node").agg(F.sum("bytes").alias("bytes"), *ends).collect():
        nodes[r.node].bytes, nodes[r.node].span = float(r["bytes"]), [(r[f"lo{i}"], r[f"hi{i}"]) for i in range(width)]


def _cut(level: DataFrame, nodes: dict[int, Node], hash_at: int, sliver: float) -> list[tuple]:
    """Rows (node, at, value, closed, fixed_at, fixed): the groups before each node's weighted median."""
    spark, cuts, todo = level.sparkSession, [], dict(nodes)
    while todo:
        params = _rows(spark, [(i, n.at, float(n.lo), float(n.hi), n.fixed_at, n.fixed) for i, n in todo.items()], _PARAMS)
        value, span = F.element_at("v", F.col("at")), F.col("hi") - F.col("lo")
        here = level.join(F.broadcast(params), "node").where(F.col("fixed_at").isNull() | (F.element_at("v", F.coalesce("fixed_at", F.lit(1))) == F.col("fixed"))).where(value.between(F.col("lo"), F.col("hi")))
        binned = here.select("node", value.alias("x"), F.when(span > 0, F.least(F.floor((value - F.col("lo")) / span * BINS), F.lit(BINS - 1))).otherwise(F.lit(0).cast("long")).alias("bin"), "bytes")
        rows = binned.groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        again = {}
        for i, n in todo.items():
            target, cum = n.bytes * (n.leaves // 2) / n.leaves, n.below
            for b in sorted((r for r in rows if r.node == i), key=lambda r: r.bin):
                if cum + b.bytes >= target:
                    break
                cum += b.bytes
            if b.n == 1 or b.bytes <= sliver or (b.lo == b.hi and n.at == hash_at):
                # whichever side brings the left part nearer to its target
                closed = (cum + b.bytes - target) < (target - cum)
                cuts.append((i, n.at, b.hi if closed else b.lo, closed, n.fixed_at, n.fixed))
                continue
            if b.lo == b.hi:  # one coordinate value: go on by the hash
                n.fixed_at, n.fixed, n.at, n.lo, n.hi, n.below = n.at, b.lo, hash_at, 0.0, 1.0, cum
            else:
                n.lo, n.hi, n.below = b.lo, b.hi, cum
            again[i] = n
        todo = again
    return cuts


def plan_shards(groups: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """(gkey, n, shard) of the groups (gkey, h, bytes, n, dims)."""
    spark, width = groups.sparkSession, len(dims)
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy: list[tuple] = []
    rest, leaves = float(total), shards
    for r in groups.select("gkey", "bytes", "n").orderBy(F.desc("bytes"), "gkey").limit(shards).collect():
        if leaves == 1 or r.bytes * leaves < rest:
            break
        heavy.append((r.gkey, r.n, shards - 1 - len(heavy)))
        rest, leaves = rest - r.bytes, leaves - 1
    alone = _rows(spark, heavy, "gkey string, n long, shard int")
    light = groups.where(~F.col("gkey").isin([k for k, _, _ in heavy])) if heavy else groups
    level = light.select("gkey", "n", "bytes", F.array(*dims, "h").alias("v"), F.lit(0).alias("node"))
    nodes, whole, last = {0: Node(0, leaves)}, None, 0
    while any(n.leaves > 1 for n in nodes.values()):
        _measure(level, nodes, width)
        whole = nodes[0].span if 0 in nodes else whole
        for n in nodes.values():
            if n.span:
                best = max(range(width), key=lambda d: (n.span[d][1] - n.span[d][0]) / ((whole[d][1] - whole[d][0]) or 1.0))
                n.at, (n.lo, n.hi), n.below, n.fixed_at, n.fixed = best + 1, n.span[best], 0.0, None, None
        split = {i: n for i, n in nodes.items() if n.leaves > 1}
        cuts = _cut(level, {i: n for i, n in split.items() if n.span}, width + 1, SLIVER * rest / max(leaves, 1))
        after, children = {i: n for i, n in nodes.items() if n.leaves == 1}, {}
        for i, n in split.items():
            k = n.leaves // 2
            children[i] = (last + 1, last + 2)
            after[last + 1], after[last + 2] = Node(n.first, k), Node(n.first + k, n.leaves - k)
            last += 2
        table = _rows(spark, [(*c, *children[c[0]]) for c in cuts], _CUTS)
        own, fixed = F.element_at("v", F.coalesce("at", F.lit(1))), F.element_at("v", F.coalesce("fixed_at", F.lit(1)))
        before = F.when(F.col("closed"), own <= F.col("value")).otherwise(own < F.col("value"))
        before = F.when(F.col("fixed_at").isNull(), before).otherwise((fixed < F.col("fixed")) | ((fixed == F.col("fixed")) & before))
        node = F.when(F.col("left_id").isNull(), F.col("node")).when(before, F.col("left_id")).otherwise(F.col("right_id"))
        level = keep(level.join(F.broadcast(table), "node", "left").select("gkey", "n", "bytes", "v", node.alias("node")), "kd-level")
        nodes = after
    shard = _rows(spark, [(i, n.first) for i, n in nodes.items()], "node int, shard int")
    return level.join(F.broadcast(shard), "node").select("gkey", "n", "shard").unionByName(alone)


def kd_shards(df: DataFrame, text: Column, doc_id: Column, dims: dict[str, Column], shards: int = 8) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot) of every row of ``df``."""
    body = F.coalesce(text, F.lit(""))
    coord = {f"d{i}": F.when(~F.isnan(c.cast("double")), c.cast("double")) for i, c in enumerate(dims.values())}
    rows = keep(df.select(doc_id.alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("gkey"),
                          *[c.alias(k) for k, c in coord.items()]), "kd-rows")
    names = list(coord)
    grouped = rows.groupBy("gkey").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *[F.min(k).alias(k) for k in names])
    # group hash in [0, 1): breaks ties of a coordinate
    h = F.conv(F.substring("gkey", 1, 12), 16, 10).cast("double") / float(1 << 48)
    groups = keep(grouped.withColumn("h", h).withColumns({k: F.coalesce(k, F.lit(-1e308)) for k in names}), "kd-groups")
    lows = groups.agg(*[F.min(F.when(F.col(k) > -1e308, F.col(k))).alias(k) for k in names]).first()
    groups = groups.withColumns({k: F.when(F.col(k) > -1e308, F.col(k)).otherwise(F.lit((lows[k] if lows[k] is not None else 0.0) - 1.0)) for k in names})
    placed = plan_shards(groups, names, shards)
    all_rows = rows.count()
    hot = F.broadcast(placed.where(F.col("n") * HOT >= F.lit(all_rows)).select("gkey", "shard"))
    cold = placed.where(F.col("n") * HOT < F.lit(all_rows)).select("gkey", "shard")
    slim = rows.select("doc_id", "size", "text_crc32", "gkey")
    out = slim.join(hot, "gkey").unionByName(slim.join(hot, "gkey", "left_anti").join(cold, "gkey")).drop("gkey")
    return number_slots(keep(out, "kd-placed"))


def number_slots(placed: DataFrame) -> DataFrame:
    """Add ``slot``: gapless from 0 within a shard, without sorting a whole shard in one task."""
    bucketed = placed.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int"))
    sizes = bucketed.groupBy("shard", "_b").count()
    offsets = sizes.select("shard", "_b", (F.sum("count").over(Window.partitionBy("shard").orderBy("_b")) - F.col("count")).alias("_o"))
    within = Window.partitionBy("shard", "_b").orderBy("doc_id", "size")
    numbered = bucketed.withColumn("_r", F.row_number().over(within) - 1)
    # offsets: shards x SLOT_BUCKETS rows
    return numbered.join(F.broadcast(offsets), ["shard", "_b"]).withColumn("slot", (F.col("_r") + F.col("_o")).cast("long")).drop("_b", "_r", "_o")


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes, copies of a text together."""
    docs = read_table(spark, sf_dir, "documents")
    dims = {"length": F.log2(F.octet_length(F.coalesce("text", F.lit(""))) + 1.0), "ingest": F.col("doc_id"),
            "source": F.crc32(F.col("source")), "lang": F.crc32(F.col("lang"))}
    out = kd_shards(docs, F.col("text"), F.col("doc_id"), dims, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
