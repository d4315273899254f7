"""Tries of conversation prefixes, by bursting containers.

A turn's id is the MD5 of role and text; a conversation is its row of ids. A
container holds, under one trie node (its head), the suffixes of the
conversations that pass through it. It starts with everything under the root.
While containers hold more than CONTAINER turns, all of these burst at once by
the next turn id (1, then 2, 4, ... STEP levels a round): their members move to
containers of their own, one per distinct continuation. What remains is small:
a task sorts a container's suffixes and sweeps them into nodes, with member
counts, leaves and savings summed on the way back up. A long suffix without
company is a chain of nodes and is written row by row.

Equal conversations are one member with a weight before the first burst, so a
group of copies is one row however large. Nodes above the containers are grouped
from their members' paths: which levels of a path its member leads (as the least
conv_id of the node) says where it branches off, so that children, leaves and
savings of any node are plain sums over its members.

Defined cases: null role and text are empty; rows of a null conv_id belong to no
conversation; null turns come first, equal turns are ordered by their id, and a
repeated row is a turn of its own; conversations without turns end at the root;
very long texts are hashed, very long conversations stay spread over rows; an
empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, read_table, word_count

#: Turns of a container that one task sweeps.
CONTAINER = 4096
#: Levels of a burst at most.
STEP = 1024
#: Rows of one window of a running sum.
CHUNK = 4096
ROOT = bytes(16)
#: The first level led by a member of which another leads all levels: it ends where that one goes on or has ended.
NEVER = 1 << 62
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _running(df: DataFrame, group: str, chunk: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the running sum of ``value`` in ``order`` within ``group``; ``chunk`` ascends with the order and bounds a window."""
    parts = df.withColumn("chunk_", chunk)
    inside = Window.partitionBy(group, "chunk_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(group).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(group, "chunk_").agg(F.sum(value).alias("sum_")).select(group, "chunk_", F.coalesce(F.sum("sum_").over(ahead), F.lit(0)).alias("ahead_"))
    return parts.withColumn("in_", F.sum(value).over(inside)).join(sums, [group, "chunk_"]).withColumn(name, F.col("in_") + F.col("ahead_")).drop("chunk_", "in_", "ahead_")


# ------------------------------------------------------------------ conversations

def turns(table: DataFrame, conv_id: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """(conv, pos, tid, words): every turn's place in its conversation, id and number of words."""
    role, body = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    tid = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, body)))
    rows = table.select(conv_id.cast("long").alias("conv"), turn.alias("turn"), tid.alias("tid"), word_count(body).alias("words")).where("conv is not null")
    chunk = F.coalesce(F.floor(F.col("turn").cast("double") / CHUNK), F.lit(-(1 << 62)))
    return _running(rows, "conv", chunk, [F.col("turn").asc_nulls_first(), F.col("tid")], F.lit(1), "pos").select("conv", F.col("pos").cast("long").alias("pos"), "tid", "words")


def rebuilt(rows: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose beginnings are shared: (conv, pos, tid, words) and (conv, n_turns).

    Conversation c gets the first h turns of conversation c - c % group, with
    h = crc32(c) % heads, then its own after its first h.
    """
    own = rows.groupBy("conv").agg(F.count("*").alias("n"))
    first = own.select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("from"), (F.crc32(F.col("conv").cast("string")) % heads).alias("h"))
    first = keep(first.join(own.select(F.col("conv").alias("from"), F.col("n").alias("from_n")), "from", "left")
                 .withColumn("got", F.least("h", F.coalesce("from_n", F.lit(0)))), "rebuilt")
    begin = first.join(rows.where(F.col("pos") < heads).withColumnRenamed("conv", "from"), "from").where("pos <= h").select("conv", "pos", "tid", "words")
    rest = rows.join(first, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "tid", "words")
    return begin.unionByName(rest), first.select("conv", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each class's texts, which come in order."""
    names = ["n_turns", "x", "y", "sha"]
    at, state = None, None
    for batch in batches:
        out = []
        for key, text in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), batch.column(3).to_pylist()):
            if key == at:
                state.update(b"," + text.encode())
                continue
            if at is not None:
                out.append((*at, state.hexdigest()))
            at, state = key, hashlib.sha256(text.encode())
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names=names)
    if at is not None:
        yield pa.record_batch([pa.array([v]) for v in (*at, state.hexdigest())], names=names)


def classes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Equal conversations as one: (q, w, n_turns, words, sha) with the least conv_id, their number, the words of one, and the digest of all ids."""
    marks = rows.groupBy("conv").agg(F.bit_xor(F.xxhash64("pos", "tid")).alias("x"), F.bit_xor(F.xxhash64("tid", "pos", F.lit(1))).alias("y"), F.sum("words").alias("words"))
    zero = F.lit(0).cast("long")
    members = keep(sizes.join(marks, "conv", "left").select("conv", "n_turns", *[F.coalesce(c, zero).alias(c) for c in ("x", "y", "words")]), "members")
    same = ["n_turns", "x", "y"]
    # conv_ids are distinct: at most CHUNK of them a text
    texts = (members.groupBy(*same, F.floor(F.col("conv") / F.lit(float(CHUNK))).alias("part"))
             .agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))
    shas = (texts.repartition(*same).sortWithinPartitions(*same, "part").select(*same, "ids").mapInArrow(_digests, "n_turns long, x long, y long, sha string"))
    return members.groupBy(*same).agg(F.min("conv").alias("q"), F.count("*").alias("w"), F.max("words").alias("words")).join(shas, same).select("q", "w", "n_turns", "words", "sha")


# ------------------------------------------------------------------ bursting

def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, n_turns, w, pos, parent, node, words, is_last) of every level that a member of a burst container descends."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            node, path = r["head"], r["path"]
            for i, s in enumerate(path):
                parent, node = node, hashlib.blake2b(node + s["tid"], digest_size=16).digest()
                out.append((r["q"], r["n_turns"], r["w"], s["pos"], parent, node, s["words"], i + 1 == len(path)))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64(), pa.bool_()])],
                                  names=["q", "n_turns", "w", "pos", "parent", "node", "words", "is_last"])


def burst(rows: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Burst containers until all hold at most CONTAINER turns or one member.

    ``rows`` (q, pos, tid, words), ``of`` (q, w, n_turns). Returns the containers'
    members (q, head, d, n_turns, w) and the paths above them
    (q, n_turns, w, pos, parent, node, words), the root included.
    """
    start = of.select("q", F.lit(ROOT).alias("head"), F.lit(0).cast("long").alias("d"), "n_turns", "w")
    at = keep(start, "containers")
    paths = start.select("q", "n_turns", "w", F.col("d").alias("pos"), F.lit(None).cast("binary").alias("parent"), F.col("head").alias("node"), F.lit(0).cast("long").alias("words"))
    levels = 1
    while True:
        # at most (all turns / CONTAINER) rows
        large = keep(at.groupBy("head").agg(F.sum(F.col("n_turns") - F.col("d")).alias("left"), F.count("*").alias("members"))
                     .where((F.col("left") > CONTAINER) & (F.col("members") > 1)).select("head"), "large")
        if large.isEmpty():
            return at, paths
        going = at.join(large, "head", "left_semi")
        inside = rows.join(going, "q").where((F.col("pos") > F.col("d")) & (F.col("pos") <= F.col("d") + levels))
        path = inside.groupBy("q", "head", "n_turns", "w").agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("path"))
        step = keep(path.mapInArrow(_steps, "q long, n_turns long, w long, pos long, parent binary, node binary, words long, is_last boolean"), "burst")
        paths = paths.unionByName(step.drop("is_last"))
        moved = step.where("is_last").select("q", F.col("node").alias("head"), F.col("pos").alias("d"), "n_turns", "w")
        at = keep(at.join(large, "head", "left_anti").unionByName(moved), "containers")
        levels = min(2 * levels, STEP)


# ------------------------------------------------------------------ sweeping

class _Node:
    __slots__ = ("depth", "least", "n", "children", "leaves", "saved", "words", "end", "below")

    def __init__(self, depth: int, words: int):
        self.depth, self.words = depth, words
        self.least, self.n, self.children, self.leaves, self.saved, self.end, self.below = None, 0, 0, 0, 0, None, []


def sweep(depth: int, members: list[tuple[bytes, int, int, list[int]]]) -> tuple[list[list], list[tuple]]:
    """Nodes below the head of one container, and what is known of each member.

    ``members``: (ids of the suffix, 16 bytes each; q; w; words of its turns).
    Nodes: [conv_id, depth, parent, n, children, leaves, saved, end]. Members:
    (q, first depth that it leads or None where that is at the head or above, its words from there on, whether its end has no children).
    """
    nodes, leads, ends = [], {}, {}
    words_of = {q: words for _, q, _, words in members}
    path = [_Node(depth, 0)]

    def close() -> None:
        x = path.pop()
        if not x.children:
            x.leaves = 1
        x.saved += (x.n - 1) * x.words
        if x.end is not None:
            ends[x.end] = x.children == 0
        for row in x.below:
            row[2] = x.least
            if row[0] != x.least:
                leads[row[0]] = (row[1], sum(words_of[row[0]][row[1] - depth - 1 :]))
        if path:
            up = path[-1]
            up.n, up.children, up.leaves, up.saved = up.n + x.n, up.children + 1, up.leaves + x.leaves, up.saved + x.saved
            up.least = x.least if up.least is None else min(up.least, x.least)
            row = [x.least, x.depth, None, x.n, x.children, x.leaves, x.saved, x.end]
            nodes.append(row)
            up.below.append(row)

    before = b""
    for ids, q, w, words in sorted(members):
        shared, most = 0, min(len(ids), len(before))
        while shared < most and ids[shared : shared + 16] == before[shared : shared + 16]:
            shared += 16
        while len(path) > shared // 16 + 1:
            close()
        for i in range(shared // 16, len(words)):
            path.append(_Node(depth + i + 1, words[i]))
        x = path[-1]
        x.n, x.end = x.n + w, q
        x.least = q if x.least is None else min(x.least, q)
        before = ids
    while path:
        close()
    return nodes, [(q, *leads.get(q, (None, None)), ends[q]) for _, q, _, _ in members]


_SWEPT = "conv_id long, depth long, parent long, n long, children long, leaves long, saved long, end long, q long, lead long, own long, leaf boolean"


def _sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and members of containers that come one after another."""
    types = [pa.int64()] * 11 + [pa.bool_()]
    names = [c.split()[0] for c in _SWEPT.split(", ")]

    def done(head: tuple, held: list) -> pa.RecordBatch:
        nodes, known = sweep(head[1], held)
        rows = [(*n, None, None, None, None) for n in nodes] + [(*[None] * 8, *m) for m in known]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    at, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            head = (r["head"], r["d"])
            if head != at and held:
                yield done(at, held)
                held = []
            at = head
            held.append((b"".join(s["tid"] for s in r["path"]), r["q"], r["w"], [s["words"] for s in r["path"]]))
    if held:
        yield done(at, held)


def trie(rows: DataFrame, of: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, end) of every node.

    ``rows`` (q, pos, tid, words): turns of distinct conversations; ``of`` (q, w, n_turns, words): weight, length and
    words of each. ``end`` is the q that ends at the node, if one does.
    """
    at, paths = burst(rows, of.select("q", "w", "n_turns"))
    left = F.col("n_turns") - F.col("d")
    # a member with more than a container's turns is alone in its container
    chain, small = at.where(left > CONTAINER), at.where(left <= CONTAINER)
    ahead = rows.join(small.select("q", "d"), "q").where("pos > d").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("path"))
    nothing = F.array().cast("array<struct<pos:bigint,tid:binary,words:bigint>>")
    suffixes = small.join(ahead, "q", "left").select("head", "d", "q", "w", F.coalesce("path", nothing).alias("path"))
    swept = keep(suffixes.repartition("head").sortWithinPartitions("head", "q").mapInArrow(_sweeps, _SWEPT), "swept")

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end"]
    below = swept.where("q is null").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
                                            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "end")

    tail = rows.join(chain.select("q", "d", "n_turns", "w"), "q").where("pos > d")
    tail = _running(tail, "q", -F.floor(F.col("pos") / F.lit(float(CHUNK))), [F.col("pos").desc()], F.col("words"), "rest")
    alone = tail.select(F.col("q").alias("conv_id"), F.col("pos").alias("depth"), F.col("q").alias("parent_conv_id"), F.col("w").alias("n_convs"), (F.col("pos") < F.col("n_turns")).cast("long").alias("n_children"),
                        F.lit(1).cast("long").alias("n_leaves"), ((F.col("w") - 1) * F.col("rest")).alias("saved_tokens"), F.when(F.col("pos") == F.col("n_turns"), F.col("q")).alias("end"))

    known = swept.where("q is not null").select("q", "lead", "own", "leaf").unionByName(chain.select("q", F.lit(None).cast("long").alias("lead"), F.lit(None).cast("long").alias("own"), F.lit(True).alias("leaf")))
    above = keep(paths.groupBy("node").agg(F.min("q").alias("q"), F.first("pos").alias("pos"), F.max(F.when(F.col("n_turns") == F.col("pos"), F.col("q"))).alias("end"), F.max("n_turns").alias("longest")), "above")
    # the first level that a member leads above its container, and whether others go on where it ends there
    led = above.groupBy("q").agg(F.min("pos").alias("above"))
    ended = above.where("end is not null").select(F.col("end").alias("q"), (F.col("longest") == F.col("pos")).alias("last"))
    known = (of.select("q", F.col("words").alias("all")).join(known, "q", "left").join(led, "q", "left").join(ended, "q", "left")
             .select("q", F.coalesce("last", "leaf").alias("leaf"), "all", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("above", "lead", F.lit(NEVER)).alias("lead")))
    mine = Window.partitionBy("q")
    up = paths.join(known, "q").withColumn("rest", F.col("all") - F.coalesce(F.sum("words").over(mine.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    up = up.withColumn("own", F.coalesce(F.max(F.when(F.col("pos") == F.col("lead"), F.col("rest"))).over(mine), "own"))
    # savings: the words of all members from here on, less those of the distinct nodes, each counted with the member that leads it
    saved = F.col("w") * F.col("rest") - F.when(F.col("pos") >= F.col("lead"), F.col("rest")).otherwise(F.col("own"))
    child = (F.col("n_turns") > F.col("pos")) & (F.col("lead") <= F.col("pos") + 1)
    nodes = keep(up.groupBy("node").agg(
        F.min("q").alias("conv_id"), F.first("pos").alias("depth"), F.first("parent").alias("parent"), F.sum("w").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(saved).alias("saved_tokens"), F.max(F.when(F.col("n_turns") == F.col("pos"), F.col("q"))).alias("end")), "upper-nodes")
    # most nodes hang on the root: its conv_id is one number
    least = nodes.agg(F.min("conv_id")).first()[0]
    by_root = (F.col("parent") == F.lit(ROOT)) | F.col("parent").isNull()
    first = nodes.where(by_root).withColumn("parent_conv_id", F.when(F.col("parent").isNotNull(), F.lit(least).cast("long")))
    deep = nodes.where(~by_root).join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    return first.select(*out).unionByName(deep.select(*out)).unionByName(below.select(*out)).unionByName(alone.select(*out))


def prefix_nodes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations (conv, pos, tid, words) of (conv, n_turns), with the digest of the ids that end there."""
    rows = keep(rows, "turns")
    of = keep(classes(rows, sizes), "classes")
    nodes = keep(trie(keep(rows.withColumnRenamed("conv", "q").join(of.select("q"), "q", "left_semi"), "distinct-turns"), of), "nodes")
    ended = nodes.where("end is not null").join(of.select(F.col("q").alias("end"), F.col("sha").alias("ends_sha256")), "end")
    return ended.unionByName(nodes.where("end is null").withColumn("ends_sha256", F.lit(NO_ENDS))).drop("end")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations with rebuilt beginnings."""
    table = read_table(spark, sf_dir, "conversations")
    rows = keep(turns(table, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")), "conversation-turns")
    return prefix_nodes(*rebuilt(rows))
