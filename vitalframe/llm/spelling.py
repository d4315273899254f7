"""Spelling variants of one edit, found by k-d trees over letter counts.

A word is a point whose coordinates are its letter counts. One inserted or
deleted letter moves the point by one along one axis, one replaced letter by one
up and one down, so near words lie within an L1 distance of two. Words of one
length share a tree; the words of a length are searched in the tree of that
length (one up, one down) and in that of the next (one up). The upper levels of
all trees are split over the cluster, level by level, at the most balanced
(letter, count) of exact histograms; a word goes to its own leaf and to every
leaf whose box its ball reaches, and each leaf is a task's group with a finer
tree inside. What the boxes let through is compared letter by letter.

Pairs never leave a leaf: it returns, for every word, how many near words it has
there and the most frequent of them.

Defined cases: null and empty texts have no words; a null doc_id counts as an
empty one; repeated rows count again; very long runs are words like any other;
ties of the most frequent near word go to the least in code-point order; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, read_table

#: Words of a leaf of the upper trees at least; beyond LEAVES times that, leaves grow.
LEAF, LEAVES = 8192, 4096
#: Rows of a leaf of the tree inside a task, and rows searched at once.
FINE, SEARCHED = 16, 1024
#: Axes: a to z, and 64 for all other characters (equal ones share an axis, which only loosens a box).
AXES = 90
#: A word is a variant of a near word at least this many times as frequent.
RATIO = 10


# ------------------------------------------------------------------ words

def word_counts(docs: DataFrame, doc_id: Column, text: Column, least_length: int = 7, least_n: int = 2, noise: int = 31) -> DataFrame:
    """(word, n): runs of Latin letters of at least ``least_length``, A-Z lower-cased, that occur ``least_n`` times.

    Where ``noise`` divides the CRC-32 h of ``<doc_id>:<run>``, the run loses its letter h % length.
    """
    runs = docs.select(F.coalesce(doc_id.cast("string"), F.lit("")).alias("i"),
                       F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("r"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = runs.select("i", F.translate("r", upper, upper.lower()).alias("r"))
    coded = low.select("r", F.crc32(F.concat("i", F.lit(":"), "r")).alias("h"), F.length("r").alias("size"))
    at = F.pmod("h", "size").cast("int")
    cut = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.col("size")))
    word = coded.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("r")).alias("word"))
    return word.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the words' lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), size


def counts(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Letter counts, a row a word."""
    axis = np.where((code >= 97) & (code <= 122), code - 97, 26 + code % 64).astype(np.int64)
    cell = np.repeat(np.arange(len(size)) * AXES, size) + axis
    return np.bincount(cell, minlength=len(size) * AXES).reshape(-1, AXES).astype(np.int32)


# ------------------------------------------------------------------ trees

class Trees:
    """Binary trees in arrays: axis, bound (at most it: left), children; a node without children is a leaf."""

    def __init__(self):
        self.axis, self.bound, self.low, self.high = ([] for _ in range(4))

    def add(self) -> int:
        for a in (self.axis, self.bound, self.low, self.high):
            a.append(-1)
        return len(self.axis) - 1

    def split(self, node: int, axis: int, bound: int) -> tuple[int, int]:
        self.axis[node], self.bound[node] = axis, bound
        self.low[node], self.high[node] = self.add(), self.add()
        return self.low[node], self.high[node]

    def arrays(self) -> list[np.ndarray]:
        return [np.array(a, np.int64) for a in (self.axis, self.bound, self.low, self.high)]


def reach(tree: list[np.ndarray], points: np.ndarray, roots: np.ndarray, ups: int, downs: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf whose box holds a point with at most ``ups`` counts more and ``downs`` fewer."""
    axis, bound, low, high = tree
    row, node = np.arange(len(points)), roots.copy()
    up, down = np.full(len(row), ups), np.full(len(row), downs)
    rows, leaves = [], []
    while len(row):
        end = low[node] < 0
        rows.append(row[end])
        leaves.append(node[end])
        row, node, up, down = (a[~end] for a in (row, node, up, down))
        over = points[row, axis[node]] - bound[node]  # above the bound by so much; 0 and less: on the low side
        to_low, to_high = down - np.maximum(over, 0), up - np.maximum(1 - over, 0)
        a, b = to_low >= 0, to_high >= 0
        row, node, up, down = (np.concatenate(x) for x in ((row[a], row[b]), (low[node[a]], high[node[b]]), (up[a], to_high[b]), (to_low[a], down[b])))
    return np.concatenate(rows or [row]), np.concatenate(leaves or [node])


def _home(tree: list[np.ndarray], roots: dict[int, int], size: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Each word's leaf; words of a length without a tree have leaf -length."""
    root = np.array([roots.get(s, -s) for s in size.tolist()], np.int64)
    has = np.flatnonzero(root >= 0)
    row, leaf = reach(tree, points[has], root[has], 0, 0)
    root[has[row]] = leaf
    return root


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 16384) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _histogram(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(node, axis, value, n): words of the open nodes by count of a letter, counts above 0 only; axis -1 has all words."""
    tree, roots, open_nodes = shared.value
    for batch in _gathered(batches):
        code, size = letters(batch.column(0).to_pylist())
        points = counts(code, size)
        home = _home(tree, roots, size, points)
        here = np.isin(home, open_nodes)
        home, points = home[here], points[here]
        node, n_all = np.unique(home, return_counts=True)
        row, axis = np.nonzero(points)
        value = points[row, axis].astype(np.int64)
        wide = int(value.max(initial=0)) + 1
        key, n = np.unique((home[row] * AXES + axis) * wide + value, return_counts=True)
        axes = np.unique(key // wide)  # the count 0 may be a bound too
        cell = np.concatenate([key // wide, axes])
        yield pa.record_batch([pa.array(np.concatenate([cell // AXES, node])), pa.array(np.concatenate([cell % AXES, np.full(len(node), -1)])),
                               pa.array(np.concatenate([key % wide, np.zeros(len(axes) + len(node), np.int64)])),
                               pa.array(np.concatenate([n, np.zeros(len(axes), np.int64), n_all]))], names=["node", "axis", "value", "n"])


def upper_trees(words: DataFrame) -> tuple[list[np.ndarray], dict[int, int]]:
    """Trees of all lengths with more than a leaf of words; the driver holds at most about 2 * LEAVES nodes."""
    sc = words.sparkSession.sparkContext
    sizes = words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n"))
    leaf = max(LEAF, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // LEAVES))
    trees, roots, todo = Trees(), {}, []
    for r in sizes.where(F.col("n") > leaf).collect():
        roots[r["size"]] = trees.add()
        todo.append(roots[r["size"]])
    while todo:
        shared = sc.broadcast((trees.arrays(), roots, np.array(todo)))
        cells = words.select("word").mapInArrow(partial(_histogram, shared=shared), "node long, axis long, value long, n long").groupBy("node", "axis", "value").agg(F.sum("n").alias("n"))
        cells = keep(cells, "letter-counts")
        one = Window.partitionBy("node", "axis")
        sides = (cells.where("axis >= 0").select("*", F.sum("n").over(one.orderBy("value")).alias("low"), F.sum("n").over(one).alias("seen"))
                 .join(cells.where("axis < 0").select("node", F.col("n").alias("all")), "node")
                 .select("node", "axis", "value", "all", (F.col("low") + F.col("all") - F.col("seen")).alias("low")))
        best = (sides.where("low < all").select("node", "all", F.struct(F.greatest("low", F.col("all") - F.col("low")).alias("most"), "axis", "value", "low").alias("s"))
                .groupBy("node").agg(F.min("s").alias("s"), F.first("all").alias("all")).collect())
        todo = []
        for r in sorted(best, key=lambda r: r.node):
            if r.s.most < r["all"]:
                low, high = trees.split(r.node, r.s.axis, r.s.value)
                todo += [node for node, n in ((low, r.s.low), (high, r["all"] - r.s.low)) if n > leaf]
        shared.unpersist()
    return trees.arrays(), roots


# ------------------------------------------------------------------ search

def _route(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(leaf, kind, word, n): kind 0 in the word's own leaf, 1 and 2 where it is searched among its length and the next."""
    tree, roots = shared.value
    for batch in batches:
        code, size = letters(batch.column(0).to_pylist())
        points = counts(code, size)
        home = _home(tree, roots, size, points)
        every = np.arange(len(size))
        parts = [(every, home, 0)]
        for kind, ups, downs in ((1, 1, 1), (2, 1, 0)):
            root = np.array([roots.get(s, -s) for s in (size + kind - 1).tolist()], np.int64)
            has = np.flatnonzero(root >= 0)
            row, leaf = reach(tree, points[has], root[has], ups, downs)
            row = has[row]
            if kind == 1:  # a pair in two leaves meets in the later one
                later = leaf > home[row]
                parts.append((row[later], leaf[later], 1))
            else:
                parts += [(row, leaf, 2), (every[root < 0], root[root < 0], 2)]
        at = pa.array(np.concatenate([p[0] for p in parts]))
        yield pa.record_batch([pa.array(np.concatenate([p[1] for p in parts])), pa.array(np.concatenate([np.full(len(p[0]), p[2], np.int32) for p in parts])),
                               batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "kind", "word", "n"])


def _fine_tree(points: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A tree down to FINE rows (or equal points): its arrays, the rows in leaf order, and each leaf's range of them."""
    trees, order, ends = Trees(), [], {}
    todo, n = [(trees.add(), np.arange(len(points)))], 0
    while todo:
        node, rows = todo.pop()
        if len(rows) > FINE:
            of = points[rows]
            middle = np.partition(of, len(rows) // 2, axis=0)[len(rows) // 2]
            # per axis, the bound at the median and the one below it
            low = np.stack([(of <= middle).sum(0), (of < middle).sum(0)])
            unlike = np.where((low > 0) & (low < len(rows)), np.abs(2 * low - len(rows)), 2 * len(rows))
            side, axis = np.unravel_index(np.argmin(unlike), unlike.shape)
            if unlike[side, axis] < 2 * len(rows):
                bound = int(middle[axis] - side)
                left = of[:, axis] <= bound
                a, b = trees.split(node, int(axis), bound)
                todo += [(b, rows[~left]), (a, rows[left])]
                continue
        order.append(rows)
        ends[node] = (n, n + len(rows))
        n += len(rows)
    span = np.array([ends.get(i, (0, 0)) for i in range(len(trees.axis))], np.int64)
    return trees.arrays(), np.concatenate(order), span[:, 0], span[:, 1]


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every integer of every range, and the range it is from."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of], of


#: Random weights of the axes: the weighted sums of two near points differ by one weight, or by that of two axes.
_WEIGHT = np.random.default_rng(7).integers(0, 1 << 63, AXES, dtype=np.uint64)
_SIEVE_BITS = np.uint64(44)


def _sieve(added: int) -> np.ndarray:
    """Leading bits of the sums' differences that near points can have."""
    steps = _WEIGHT if added else (_WEIGHT[:, None] - _WEIGHT[None, :]).ravel()
    out = np.zeros(1 << 20, bool)
    out[steps >> _SIEVE_BITS] = True
    return out


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether b is a with one more letter: what they share at both ends covers a."""
    n = a.shape[1]
    head = np.where((same := a == b[:, :-1]).all(1), n, np.argmin(same, 1))
    tail = np.where((same := (a == b[:, 1:])[:, ::-1]).all(1), n, np.argmin(same, 1))
    return head + tail >= n


def _near(batch: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of the words of one leaf that have near words in it, or search there."""
    kind = batch.column("kind").to_numpy()
    text = batch.column("word").combine_chunks()
    n = batch.column("n").to_numpy()
    code, size = letters(text.to_pylist())
    start = np.cumsum(size) - size
    points = counts(code, size)
    total = (points.astype(np.uint64) * _WEIGHT).sum(1)
    home = np.flatnonzero(kind == 0)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    if len(home):
        width = int(size[home[0]])
        tree, order, first, last = _fine_tree(points[home])
        order = home[order]
        place = np.full(len(kind), -1)
        place[order] = np.arange(len(order))
        for k, ups, downs in ((0, 1, 1), (1, 1, 1), (2, 1, 0)):
            asked, sieve, own = np.flatnonzero(kind == k), _sieve(k == 2), width - (k == 2)
            for at in range(0, len(asked), SEARCHED):
                part = asked[at : at + SEARCHED]
                row, leaf = reach(tree, points[part], np.zeros(len(part), np.int64), ups, downs)
                found, of = _ranges(first[leaf], last[leaf])
                a, b = part[row[of]], order[found]
                if k == 0:  # each pair once
                    a, b = a[keep_ := found > place[a]], b[keep_]
                fits = sieve[(total[b] - total[a]) >> _SIEVE_BITS]
                a, b = a[fits], b[fits]
                x, y = code[start[a][:, None] + np.arange(own)], code[start[b][:, None] + np.arange(width)]
                right = _one_inserted(x, y) if k == 2 else _one_replaced(x, y)
                links.append((a[right], b[right]))
    a, b = (np.concatenate([x[i] for x in links] or [np.zeros(0, np.int64)]) for i in (0, 1))
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    n_near = np.bincount(a, minlength=len(kind))
    best_n = np.zeros(len(kind), np.int64)
    np.maximum.at(best_n, a, n[b])
    by_text = np.empty(len(kind), np.int64)
    by_text[pc.sort_indices(text).to_numpy()] = np.arange(len(kind))
    best = np.full(len(kind), len(kind))
    top = n[b] == best_n[a]
    np.minimum.at(best, a[top], by_text[b[top]])
    has = np.flatnonzero(n_near)
    word_of = np.argsort(by_text)
    return pa.table({"word": text.take(pa.array(has)), "n_near": n_near[has].astype(np.int64), "best_n": best_n[has], "best": text.take(pa.array(word_of[best[has]]))})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n; distinct) that has one: how many, and the most frequent."""
    shared = words.sparkSession.sparkContext.broadcast(upper_trees(words))
    routed = words.select("word", "n").mapInArrow(partial(_route, shared=shared), "leaf long, kind int, word string, n long")
    found = routed.groupBy("leaf").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("s")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", (-F.col("s.m")).alias("best_n"), F.col("s.best").alias("best"))


# ------------------------------------------------------------------ groups

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form): the last of its forms, by pointer doubling."""
    at = keep(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = keep(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n): a word's form is its most frequent near
    word, if at least ``ratio`` times as frequent; its root is the last of its forms."""
    words = keep(words.select("word", "n"), "words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = keep(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "near-words")
    # words without a form are their own roots
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variant_groups(word_counts(read_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text")))
