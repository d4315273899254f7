"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to). The flow network has one node a pattern and one a source: every
pass over a pattern offers its words once, at a cost that rises with the pass
(convex), members carry flow from pattern to source, and a source takes up to
its quota. Only this aggregate, one row a distinct pattern, is solved on the
driver; its size depends on the number of sources, not of documents.

The flow says how many words of a pattern each source draws in each pass. Whole
documents are then chosen in a seeded hash order by prefix sums, which are
computed over hash buckets so that a source with a third of all rows is spread
over many tasks. The gap that whole documents leave at a prefix's end is filled
by further seeded documents that fit, in ``GAP_ROUNDS`` rounds; the smallest
open document is added at last, and documents given back for what it takes too
much, where that ends nearer.

Defined cases: null text has size 0 and is never taken; a null source is a
source of its own, ordered last; equal (doc_id, size) rows are separate rows in
an arbitrary but equivalent order; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bounded, free_names, keep, read_table, word_count

#: Distinct membership patterns the driver accepts (an error beyond, never a cut).
MAX_PATTERNS = 100_000
#: Hash buckets of a pattern's prefix sums.
BUCKETS = 512
#: Passes that fill the gap left by whole documents.
GAP_ROUNDS = 2
#: Relative weights by source rank, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Cost of the first, second, ... pass over a document's words.
PASS_COSTS = (0.0, 1.0)
SEED = 20


def source_targets(sizes: dict, total: float, most: float, weights: tuple = WEIGHTS) -> dict:
    """Share ``total`` by weight (rank by code point, null last); none above ``most`` times its size."""
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    target, free, left = {}, set(ranked), float(total)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * unit for s in free}
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return target


def route(patterns: dict, quotas: dict, costs: tuple = PASS_COSTS) -> tuple[dict, list]:
    """Min-cost maximum flow: (words by (pattern, source), words by pattern for each pass).

    Costs sit only on the arcs that enter the patterns, so the passes can be
    offered in order of cost, each with a maximum flow by shortest augmenting
    paths in the residual network that the passes before it left.
    """
    flow = {(p, s): 0 for p in patterns for s in p}
    members: dict = {s: [] for s in quotas}
    for p in patterns:
        for s in p:
            members[s].append(p)
    free = {s: int(q) for s, q in quotas.items()}
    passes = []
    for _ in sorted(costs):
        room = dict(patterns)
        for p in patterns:  # a pattern of one source has one way to go
            if len(p) == 1:
                amount = min(room[p], free[p[0]])
                flow[p, p[0]] += amount
                room[p] -= amount
                free[p[0]] -= amount
        while True:
            came = {("pattern", p): None for p in room if room[p] > 0} if any(free.values()) else {}
            todo, end = deque(came), None
            while todo and end is None:
                kind, x = node = todo.popleft()
                nexts = [("source", s) for s in x] if kind == "pattern" else [("pattern", p) for p in members[x] if flow[p, x] > 0]
                for nxt in nexts:
                    if nxt not in came:
                        came[nxt] = node
                        todo.append(nxt)
                        if nxt[0] == "source" and free[nxt[1]] > 0:
                            end = nxt
                            break
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            steps = list(zip(path, path[1:]))
            amount = min([room[path[0][1]], free[end[1]], *(flow[b[1], a[1]] for a, b in steps if a[0] == "source")])
            for a, b in steps:
                if a[0] == "pattern":
                    flow[a[1], b[1]] += amount
                else:
                    flow[b[1], a[1]] -= amount
            room[path[0][1]] -= amount
            free[end[1]] -= amount
        passes.append({p: patterns[p] - room[p] for p in patterns})
    return flow, passes


def _before(rows: DataFrame, weight: Column) -> DataFrame:
    """Add ``before``: the weight of the pattern's rows ahead in seeded order."""
    rows = rows.withColumn("_w", weight).withColumn("_b", F.floor(F.col("u") * BUCKETS).cast("int"))
    sums = rows.groupBy("pattern", "_b").agg(F.sum("_w").alias("_sum"))
    starts = sums.select("pattern", "_b", (F.sum("_sum").over(Window.partitionBy("pattern").orderBy("_b")) - F.col("_sum")).alias("_start"))
    ahead = Window.partitionBy("pattern", "_b").orderBy("u", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_w").over(ahead), F.lit(0)))
    return rows.join(starts, ["pattern", "_b"]).withColumn("before", F.col("_start") + F.col("_in")).drop("_w", "_b", "_start", "_in")


def mix(df: DataFrame, doc_id: Column, size: Column, sources: Column, targets, seed: int = SEED, extra: tuple = ()) -> tuple[DataFrame, dict, dict]:
    """Choose how often (0 to len(PASS_COSTS) times) each document is taken.

    ``sources`` is the array of a row's sources; ``targets`` maps {source: words}
    to {source: target}. Returns rows (doc_id, size, pattern, u, copies, *extra),
    the source sizes and the targets. ``extra`` names further columns to carry.
    """
    spark, n = df.sparkSession, len(PASS_COSTS)
    member = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.struct(s.isNull().alias("n"), F.coalesce(s, F.lit("")).alias("s")))))
    rows = keep(df.select(doc_id.alias("doc_id"), size.alias("size"), F.to_json(member).alias("pattern"), F.monotonically_increasing_id().alias("rid"), *extra), "mix-rows")
    name, words, sizes = {}, {}, {}
    for r in bounded(rows.groupBy("pattern").agg(F.sum("size").alias("w")), MAX_PATTERNS, "membership patterns"):
        name[r.pattern] = p = tuple(None if m["n"] else m["s"] for m in json.loads(r.pattern))
        words[p] = int(r.w)
        for s in p:
            sizes[s] = sizes.get(s, 0) + words[p]
    target = targets(sizes)
    _, passes = route(words, {s: round(t) for s, t in target.items()})
    want = spark.createDataFrame([(k, *[int(d[p]) for d in passes]) for k, p in name.items()], "pattern string, " + ", ".join(f"want{i} long" for i in range(n)))
    seeded = rows.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(1 << 40)) / float(1 << 40))
    # at most MAX_PATTERNS rows
    ordered = _before(seeded.join(F.broadcast(want), "pattern"), F.col("size"))
    copies = sum((F.when((F.col("size") > 0) & (F.col("before") + F.col("size") <= F.col(f"want{i}")), 1).otherwise(0) for i in range(n)), F.lit(0))
    wanted = sum((F.col(f"want{i}") for i in range(n)), F.lit(0))
    taken = keep(ordered.select("doc_id", "size", "pattern", "u", "rid", copies.alias("copies"), wanted.alias("wanted"), *extra), "mix-taken")
    for _ in range(GAP_ROUNDS):
        left = taken.groupBy("pattern").agg((F.max("wanted") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
        open_ = taken.join(F.broadcast(left), "pattern")
        fits = (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & (F.col("copies") < n)
        # cheapest pass first: only the documents taken the fewest times so far
        lowest = open_.where(fits).groupBy("pattern").agg(F.min("copies").alias("lowest"))
        fits = fits & F.coalesce(F.col("copies") == F.col("lowest"), F.lit(False))
        open_ = _before(open_.join(F.broadcast(lowest), "pattern", "left").withColumn("fits", fits), F.when(F.col("fits"), F.col("size")).otherwise(0))
        more = F.when(F.col("fits") & (F.col("before") + F.col("size") <= F.col("gap")), 1).otherwise(0)
        taken = keep(open_.select("doc_id", "size", "pattern", "u", "rid", (F.col("copies") + more).alias("copies"), "wanted", *extra), "mix-gap")
    # what is left is smaller than any open document: try the smallest one, and give back
    # seeded documents for what it takes too much; rid, written with the rows, tells equal rows apart
    again = (F.col("size") > 0) & (F.col("copies") < n)
    last = taken.groupBy("pattern").agg((F.max("wanted") - F.sum(F.col("size") * F.col("copies"))).alias("gap"), F.min(F.when(again, F.struct("size", "u", "doc_id", "rid"))).alias("least"))
    last = last.where((F.col("gap") > 0) & F.col("least").isNotNull()).select("pattern", "gap", F.col("least.rid").alias("added"), (F.col("least.size") - F.col("gap")).alias("over"))
    tried = taken.join(F.broadcast(last), "pattern", "left").withColumn("plus", F.coalesce(F.col("rid") == F.col("added"), F.lit(False)))
    spare = F.coalesce((F.col("over") > 0) & ~F.col("plus") & (F.col("copies") >= 1) & (F.col("size") > 0) & (F.col("size") <= F.col("over")), F.lit(False))
    # the dearest pass first: only documents taken the most times
    most = tried.where(spare).groupBy("pattern").agg(F.max("copies").alias("most"))
    tried = tried.join(F.broadcast(most), "pattern", "left").withColumn("spare", spare & F.coalesce(F.col("copies") == F.col("most"), F.lit(False)))
    tried = _before(tried, F.when(F.col("spare"), F.col("size")).otherwise(0))
    tried = keep(tried.withColumn("minus", F.col("spare") & (F.col("before") + F.col("size") <= F.col("over"))), "mix-last")
    back = tried.groupBy("pattern").agg(F.sum(F.when(F.col("minus"), F.col("size")).otherwise(0)).alias("back"))
    tried = tried.join(F.broadcast(back), "pattern")
    nearer = F.coalesce(F.col("over") - F.col("back") < F.col("gap"), F.lit(False))
    copies = F.when(nearer, F.col("copies") + F.col("plus").cast("int") - F.col("minus").cast("int")).otherwise(F.col("copies"))
    return tried.select("doc_id", "size", "pattern", "u", copies.alias("copies"), *extra), sizes, target


def one_source(df: DataFrame, sizes: dict, target: dict) -> DataFrame:
    """Add ``source_size`` and ``target`` to rows that carry a single ``source``."""
    facts = df.sparkSession.createDataFrame([(s, int(sizes[s]), float(target[s])) for s in sizes], "_s string, source_size long, target double")
    return df.join(F.broadcast(facts), df["source"].eqNullSafe(facts["_s"])).drop("_s")


def share(most: float = 2.0, part: float = 1.5):
    """Targets: ``part`` of all words by weight, none above ``most`` times its source."""
    return lambda sizes: source_targets(sizes, part * sum(sizes.values()), most)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 3, 1, 2, repeating."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    taken, sizes, target = mix(docs, F.col("doc_id"), F.col("size"), F.array("source"), share(), extra=("source",))
    return one_source(taken, sizes, target).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it (a document taken twice is two rows).

    Weights, total and cap are those of the query, over the stage's own words.
    Rows equal in doc_id, source and size share what the mix takes of them.
    """
    key = F.to_json(F.struct("doc_id", "source", word_count(F.col("text")).alias("size")))
    taken, _, _ = mix(docs, F.col("doc_id"), word_count(F.col("text")), F.array("source"), share(), extra=("source",))
    same, total, rows, times, nth = free_names(docs.columns, "key", "total", "rows", "times", "nth")
    alike = taken.groupBy(F.to_json(F.struct("doc_id", "source", "size")).alias(same)).agg(F.sum("copies").alias(total), F.count("*").alias(rows)).where(F.col(total) > 0)
    joined = docs.withColumn(same, key).join(alike, same)
    place = F.row_number().over(Window.partitionBy(same).orderBy("text"))
    copies = F.floor(F.col(total) / F.col(rows)) + F.when(place <= F.col(total) % F.col(rows), 1).otherwise(0)
    return joined.withColumn(times, copies.cast("int")).where(F.col(times) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(nth)).select(*docs.columns)
