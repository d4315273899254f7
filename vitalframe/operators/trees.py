"""Histogram trees: second-order boosting and forests, many models at a time (M3-M5).

A level of trees needs only sums of gradients, hessians and rows by (tree node,
feature, bin). ``level_sums`` takes them for any number of trees over one block of
rows; ``best_splits`` turns them into splits with the booster's own limits:
hessian weight of a child, L2 term, least gain, rows of a split and of a leaf. So
one pass serves all folds and parameter sets that are grown together.

Over a table the rows stay where they are, in blocks: every level is one pass over
all blocks, a task's sums come back. Features of few bins share a code there, so one
count serves several. Row and column samples are hashes of (row key, model, round),
the same wherever a row lies.

A feature's bins are cut at quantiles; a missing value falls into bin 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from vitalframe.operators.ordered import exclusive_prefix_sums

#: Bins of a feature.
BINS = 32
#: Rows of a block of a table.
BLOCK_ROWS = 65536
#: Rounds between written states of a distributed fit.
WRITE_EVERY = 20
#: Trees of a forest grown together in a task, and their rows in all.
FOREST_TREES, FOREST_ROWS = 25, 200_000
#: Cells of a code that several features share.
PACK_CELLS = 1024
#: Tasks whose sums the driver adds; those of more are added in the cluster first.
DRIVER_SUMS = 48


@dataclass
class TreeParams:
    """One model: ``kind`` is "xgb" (second order), "gb" (first-order splits, Newton leaves) or "forest"."""
    kind: str = "xgb"
    rounds: int = 100
    depth: int = 5
    rate: float = 0.1
    child_weight: float = 1.0   # least hessian sum of a child ("xgb")
    l2: float = 1.0             # on leaf values ("xgb")
    gain: float = 0.0           # least gain of a split ("xgb")
    split_rows: int = 2
    leaf_rows: int = 1
    rows: float = 1.0           # share of rows a round
    columns: float = 1.0        # share of features a tree
    seed: int = 42

    @staticmethod
    def of(name: str, params: dict, seed: int) -> "TreeParams":
        """From the registry's parameter names."""
        p = TreeParams(rounds=int(params["n_estimators"]), depth=int(params["max_depth"]), split_rows=int(params.get("min_samples_split", 2)), leaf_rows=int(params.get("min_samples_leaf", 1)), seed=seed)
        if name == "Random_Forest":
            p.kind, p.rate, p.l2 = "forest", 1.0, 0.0
        elif name == "Gradient_Boosting":
            p.kind, p.rate, p.l2 = "gb", float(params["learning_rate"]), 0.0
        else:
            p.rate, p.child_weight, p.rows, p.columns = float(params["learning_rate"]), float(params.get("min_child_weight", 1)), float(params.get("subsample", 1.0)), float(params.get("colsample_bytree", 1.0))
            p.l2, p.gain = float(params.get("reg_lambda", 1.0)), float(params.get("gamma", 0.0))
        return p


# ------------------------------------------------------------------ hashes and bins

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def unit(key: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) of 64-bit keys."""
    x = key.astype(np.int64).view(np.uint64)
    for s in salt:
        x = _mixed(x + np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Cuts of every feature at its quantiles, one aggregate; a value goes to the bin of the number of cuts below it."""
    probs = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 100_000).alias(f"c{i}") for i, c in enumerate(features)]).first()
    return [sorted({x for x in v or [] if x == x}) for v in row]  # NaN has no place in an order


def fold_edges(folded: DataFrame, features: list[str], bins: int = BINS) -> dict[int, list[list[float]]]:
    """Cuts of every feature at the exact quantiles of each fold's training rows (all rows of the other folds).

    One count of every feature's distinct values by fold serves all folds: ranks come from
    distributed prefix sums over them, and the driver gets the cuts alone.
    """
    folds = sorted(r[0] for r in folded.select("fold").distinct().collect())
    if not folds:
        return {}
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(features)]))
    values = folded.select("fold", each.alias("x")).select("fold", "x.*").where("value is not null and not isnan(value)")
    taken = [f"n{f}" for f in folds]
    counts = values.groupBy("feature", "value").agg(*[F.count_if(F.col("fold") != f).alias(c) for f, c in zip(folds, taken)])
    ranked = exclusive_prefix_sums(counts, ["feature"], ["value"], taken, materialize=True)
    total = ranked.groupBy(F.col("feature").alias("of")).agg(*[F.sum(c).alias(f"all_{c}") for c in taken])
    x = ranked.join(total, F.col("feature") == F.col("of"))
    # a value is a cut where its rows hold the rank of a quantile
    step = lambda rank, c: F.least(F.lit(bins - 1), F.floor(rank * bins / F.greatest(F.col(f"all_{c}"), F.lit(1))))
    cut = F.array(*[F.when(step(F.col(f"before_{c}") + F.col(c), c) > step(F.col(f"before_{c}"), c), F.lit(f)) for f, c in zip(folds, taken)])
    out: dict[int, list[list[float]]] = {f: [[] for _ in features] for f in folds}
    for r in x.select("feature", "value", F.explode(F.array_compact(cut)).alias("fold")).collect():
        out[r.fold][r.feature].append(r.value)
    return {f: [sorted(v) for v in e] for f, e in out.items()}


def to_bins(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bins of a matrix of feature values."""
    out = np.zeros(values.shape, np.uint8)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(values[:, k]), 0, np.searchsorted(np.array(e), values[:, k], "left"))
    return out


# ------------------------------------------------------------------ a level

def level_sums(bins: np.ndarray, row: np.ndarray, slot: np.ndarray, chosen: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray, n_bins: int = BINS) -> np.ndarray:
    """Sums of (g, h, w) by node, chosen feature and bin: (3, columns, slots, bins). ``row`` and ``slot`` pair rows with nodes."""
    slots, columns = chosen.shape
    out = np.empty((3, columns, slots, n_bins))
    for k in range(columns):
        cell = slot * n_bins + bins[row, chosen[slot, k]]
        for i, v in enumerate((g, h, w)):
            out[i, k] = np.bincount(cell, v, slots * n_bins).reshape(slots, n_bins)
    return out


def best_splits(sums: np.ndarray, params: list[TreeParams], model: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Per node: whether it splits, the place of the feature among the chosen ones, the last bin of the left side, and its value as a leaf."""
    left = sums.cumsum(3)
    total = left[:, 0, :, -1]
    per = lambda f, t=float: np.array([f(p) for p in params], t)[model]
    second, l2 = per(lambda p: p.kind == "xgb", bool), per(lambda p: p.l2)
    weight = lambda s: np.where(second.reshape(-1, 1) if s.ndim > 2 else second, s[1], s[2])

    def score(s: np.ndarray) -> np.ndarray:
        of = weight(s) + (l2.reshape(-1, 1) if s.ndim > 2 else l2)
        return np.divide(s[0] ** 2, of, out=np.zeros_like(of), where=of > 1e-12)

    right = total[:, None, :, None] - left
    gain = score(left) + score(right) - score(total)[None, :, None]
    column = lambda v: v.reshape(1, -1, 1)
    least_w, least_rows = column(per(lambda p: p.child_weight if p.kind == "xgb" else 0.0)), column(per(lambda p: max(p.leaf_rows, 1)))
    right_side = (left[1] >= least_w) & (right[1] >= least_w) & (left[2] >= least_rows - 1e-9) & (right[2] >= least_rows - 1e-9)
    gain = np.where(right_side, gain, -np.inf).transpose(1, 0, 2).reshape(sums.shape[2], -1)
    at = gain.argmax(1)
    best = gain[np.arange(len(at)), at]
    # booster convention: half the difference must exceed the least gain
    splits = (best / 2 > per(lambda p: p.gain) + 1e-10) & (total[2] >= per(lambda p: p.split_rows)) & (per(lambda p: p.depth, int) > depth)
    forest = per(lambda p: p.kind == "forest", bool)
    below = np.where(forest, total[2], total[1] + l2)
    value = np.divide(-total[0], below, out=np.zeros_like(below), where=below > 1e-12)
    return splits, at // sums.shape[3], at % sums.shape[3], value


class Trees:
    """Trees of a level-by-level growth in flat arrays; one root a tree, children of a leaf are -1."""

    def __init__(self):
        self.feature, self.bound = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.low, self.high, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, n: int) -> np.ndarray:
        first = len(self.feature)
        more = lambda a, v: np.concatenate([a, np.full(n, v, a.dtype)])
        self.feature, self.bound, self.low, self.high, self.value = more(self.feature, 0), more(self.bound, 0), more(self.low, -1), more(self.high, -1), more(self.value, 0)
        return np.arange(first, first + n)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.feature, self.bound, self.low, self.high, self.value


def _chosen(params: list[TreeParams], tree: np.ndarray, model: np.ndarray, place: np.ndarray, turn: int, n_features: int) -> np.ndarray:
    """Features of every node, in order: a sample a tree for boosting, a sample of their square root a node for forests."""
    forest = np.array([p.kind == "forest" for p in params])[model]
    count = np.array([max(1, int(np.sqrt(n_features))) if p.kind == "forest" else max(1, int(round(p.columns * n_features))) for p in params])[model]
    seed = np.array([p.seed for p in params])[model]
    # a forest's trees are told apart by their number, a booster's by its round
    key = (np.where(forest, place, 0) << 24) + turn + np.where(forest, tree, 0)
    order = np.argsort(unit((key[:, None] * 64 + np.arange(n_features)) ^ (seed[:, None] << 40), 3), axis=1, kind="stable")
    # a node with fewer features than another of the batch repeats its own
    pick = np.arange(count.max()) % count[:, None]
    return np.sort(np.take_along_axis(order, pick, 1), axis=1)


class Growth:
    """Trees of one round, grown level by level; tree t belongs to model ``model[t]``."""

    def __init__(self, params: list[TreeParams], model: np.ndarray, turn: int, n_features: int):
        self.params, self.model, self.turn, self.n_features = params, model, turn, n_features
        self.trees, self.depth = Trees(), 0
        self.roots = self.trees.add(len(model))
        self.open, self.tree_of, self.place = self.roots.copy(), np.arange(len(model)), np.arange(len(model))
        self._choose()

    def _choose(self) -> None:
        # a node is told apart by its place in the level order of its own tree
        self.chosen = _chosen(self.params, self.tree_of, self.model[self.tree_of], self.place, self.turn, self.n_features)

    def split(self, sums: np.ndarray) -> bool:
        """Take a level's sums; whether there is another level."""
        splits, k, bound, value = best_splits(sums, self.params, self.model[self.tree_of], self.depth)
        t = self.trees
        t.value[self.open] = value
        at = np.flatnonzero(splits)
        self.cut = at, k[at], bound[at]
        children = t.add(2 * len(at))
        parent = self.open[at]
        t.feature[parent], t.bound[parent] = self.chosen[at, k[at]], bound[at]
        t.low[parent], t.high[parent] = children[::2], children[1::2]
        self.open, self.tree_of = children, np.repeat(self.tree_of[at], 2)
        self.place = np.repeat(self.place[at], 2) * 2 + np.tile([1, 2], len(at))
        self.depth += 1
        if len(children):
            self._choose()
        return bool(len(children))

    def close(self, sums: np.ndarray) -> None:
        """Values of a booster's last level from the sums of the level above, which tell its sums without a pass."""
        at, k, bound = self.cut
        cells = sums[:, k, at]
        low = np.take_along_axis(cells.cumsum(2), bound.reshape(1, -1, 1), 2)[:, :, 0]
        g, h, _ = np.stack([low, cells.sum(2) - low], 2).reshape(3, -1)
        below = h + np.array([p.l2 for p in self.params])[self.model[self.tree_of]]
        self.trees.value[self.open] = np.divide(-g, below, out=np.zeros_like(below), where=below > 1e-12)


def descend(arrays: tuple[np.ndarray, ...], bins: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Leaves (or open nodes) reached by all rows from ``node`` (trees, rows)."""
    feature, bound, low, high, _ = arrays
    row = np.broadcast_to(np.arange(bins.shape[0]), node.shape)
    while True:
        inner = low[node] >= 0
        if not inner.any():
            return node
        left = bins[row, feature[node]] <= bound[node]
        node = np.where(inner, np.where(left, low[node], high[node]), node)


# ------------------------------------------------------------------ many models over one block

def _weights(p: TreeParams, key: np.ndarray, turn: int, taking: np.ndarray) -> np.ndarray:
    """Weight of every row in one tree: the training rows, sampled as the model samples them."""
    w = taking.astype(float)
    if p.kind == "forest":  # a bootstrap draws every row a Poisson number of times
        u, n, tail, step = unit(key, p.seed, turn, 1), np.zeros(len(key)), np.exp(-1.0), np.exp(-1.0)
        for k in range(1, 9):
            n += u >= tail
            step /= k
            tail += step
        return w * n
    return w * (unit(key, p.seed, turn, 2) < p.rows) if p.rows < 1 else w


def _gradients(p: TreeParams, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if p.kind == "forest":
        return -y * w, w
    prob = 1 / (1 + np.exp(-margin))
    return (prob - y) * w, prob * (1 - prob) * w


def start_margin(p: TreeParams, positive: float) -> float:
    """Margin before the first tree: the log-odds of the training rows for "gb", 0 otherwise."""
    share = min(max(positive, 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share))) if p.kind == "gb" else 0.0


def grow_in_block(bins: np.ndarray, growth: Growth, g: np.ndarray, h: np.ndarray, w: np.ndarray, n_bins: int = BINS) -> np.ndarray:
    """Grow a round's trees from one block that holds all rows; every row's leaf (trees, rows)."""
    node = np.repeat(growth.roots[:, None], bins.shape[0], 1)
    more = True
    while more:
        slot = np.full(len(growth.trees.feature), -1)
        slot[growth.open] = np.arange(len(growth.open))
        tree, row = np.nonzero((slot[node] >= 0) & (w > 0))
        sums = level_sums(bins, row, slot[node[tree, row]], growth.chosen, g[tree, row], h[tree, row], w[tree, row], n_bins)
        more = growth.split(sums)
        node = descend(growth.trees.arrays(), bins, node)
    return node


def margins(bins: np.ndarray, y: np.ndarray, key: np.ndarray, params: list[TreeParams], taking: np.ndarray, report: list[list[int]], n_bins: int = BINS, keep_trees: list | None = None) -> list[dict[int, np.ndarray]]:
    """Fit all models on one block; per model the margins (forests: mean leaf shares) of all rows after the rounds asked for.

    ``taking`` (models, rows) marks each model's training rows; ``report`` lists
    each model's numbers of rounds. Boosted models advance one round at a time,
    all together; a forest's trees are grown FOREST_TREES at a time, fewer over many rows.
    """
    n, out = len(y), [{} for _ in params]
    total = np.stack([np.full(n, start_margin(p, y[t].mean() if t.any() else 0.5)) for p, t in zip(params, taking)])
    boosted = [m for m, p in enumerate(params) if p.kind != "forest"]
    for turn in range(max((max(report[m]) for m in boosted), default=0)):
        live = [m for m in boosted if turn < max(report[m])]
        w = np.stack([_weights(params[m], key, turn, taking[m]) for m in live])
        gh = [_gradients(params[m], total[m], y, w[i]) for i, m in enumerate(live)]
        growth = Growth(params, np.array(live), turn, bins.shape[1])
        leaf = grow_in_block(bins, growth, np.stack([a for a, _ in gh]), np.stack([b for _, b in gh]), w, n_bins)
        value = growth.trees.arrays()[4]
        total[live] += np.array([params[m].rate for m in live])[:, None] * value[leaf]
        if keep_trees is not None:
            keep_trees.append((live, growth))
        for m in live:
            if turn + 1 in report[m]:
                out[m][turn + 1] = total[m].copy()
    for m in (m for m, p in enumerate(params) if p.kind == "forest"):
        share, done = np.zeros(n), 0
        most = max(1, min(FOREST_TREES, FOREST_ROWS // max(n, 1)))
        for first in range(0, max(report[m]), most):
            turns = np.arange(first, min(first + most, max(report[m])))
            w = np.stack([_weights(params[m], key, int(t), taking[m]) for t in turns])
            growth = Growth(params, np.full(len(turns), m), first, bins.shape[1])
            leaf = grow_in_block(bins, growth, -y * w, w, w, n_bins)
            if keep_trees is not None:
                keep_trees.append(([m] * len(turns), growth))
            for rows in growth.trees.arrays()[4][leaf]:
                share, done = share + rows, done + 1
                if done in report[m]:
                    out[m][done] = share / done
    return out


# ------------------------------------------------------------------ one table, any size

@dataclass
class BoostedModel:
    """A fitted booster: cuts of the bins, and trees in flat arrays with bounds as bins."""
    features: list[str]
    edges: list[list[float]]
    start: float
    rate: float
    trees: list[dict]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(s: str) -> "BoostedModel":
        return BoostedModel(**json.loads(s))


_BLOCK = "block long, n long, bins binary, y binary, key binary, margin binary"


def _blocks(batches: Iterator[pa.RecordBatch], edges: list[list[float]], start: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, y, features) as binned blocks of their task."""
    held, n, block = [], 0, 0

    def made() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        x = np.stack([table.column(i).to_numpy().astype(float) for i in range(2, table.num_columns)], 1)
        cols = [to_bins(x, edges).tobytes(), table.column(1).to_numpy().astype(float).tobytes(), table.column(0).to_numpy().astype(np.int64).tobytes(), np.full(len(x), start).tobytes()]
        return pa.record_batch([pa.array([block]), pa.array([len(x)]), *(pa.array([c]) for c in cols)], names=["block", "n", "bins", "y", "key", "margin"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield made()
            held, n, block = [], 0, block + 1
    if n:
        yield made()


def _read(r: dict | Row, features: int) -> tuple[np.ndarray, ...]:
    return (np.frombuffer(r["bins"], np.uint8).reshape(r["n"], features), np.frombuffer(r["y"], float), np.frombuffer(r["key"], np.int64), np.frombuffer(r["margin"], float))


def packs(sizes: list[int], cells: int = PACK_CELLS) -> list[list[int]]:
    """Features in groups whose numbers of bins multiply to at most ``cells``."""
    out: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = next((g for g in out if int(np.prod([sizes[i] for i in g])) * sizes[f] <= cells), None)
        out.append([f]) if fits is None else fits.append(f)
    return out


@dataclass
class Held:
    """A block of a distributed fit: bins, a code a group of ``packs``, and every model's margins and rows that the round takes."""
    bins: np.ndarray
    codes: list[np.ndarray]
    y: np.ndarray
    key: np.ndarray
    margin: np.ndarray
    taken: np.ndarray

    def taking(self, params: list[TreeParams], turn: int) -> "Held":
        every = np.ones(len(self.y), bool)
        self.taken = np.stack([_weights(p, self.key, turn, every) > 0 for p in params])
        return self


def _held(rows: Iterator[Row], p: TreeParams | list[TreeParams], groups: list[list[int]], sizes: list[int]) -> Iterator[Held]:
    params = [p] if isinstance(p, TreeParams) else p
    for r in rows:
        bins, y, key, margin = _read(r, len(sizes))
        codes = []
        for g in groups:
            code = np.zeros(len(y), np.int64)
            for f in g:
                code = code * sizes[f] + bins[:, f]
            codes.append(code.astype(np.uint16 if code.max(initial=0) < 1 << 16 else np.int64))
        yield Held(bins, codes, y, key, np.repeat(margin[None, :], len(params), 0), y > 0).taking(params, 0)


def walk(arrays: tuple[np.ndarray, ...], bins: np.ndarray, root: int, levels: int) -> np.ndarray:
    """Leaf or open node of every row, in one tree of at most so many levels."""
    feature, bound, low, high, _ = arrays
    flat, first = bins.ravel(), np.arange(bins.shape[0]) * bins.shape[1]
    # a leaf is its own child
    own = np.arange(len(low))
    children = np.stack([np.where(low < 0, own, high), np.where(low < 0, own, low)], 1).ravel()
    node = np.full(bins.shape[0], root)
    for _ in range(levels):
        node = children[2 * node + (flat[first + feature[node]] <= bound[node])]
    return node


def _level(blocks: Iterator[Held], shared) -> Iterator[np.ndarray]:
    """A task's sums of the open nodes of a round's trees, as ``level_sums`` has them."""
    growth, groups, sizes, n_bins = shared.value
    arrays, slots = growth.trees.arrays(), len(growth.open)
    slot_of = np.full(len(arrays[0]), -1)
    slot_of[growth.open] = np.arange(slots)
    cells = [int(np.prod([sizes[f] for f in g])) for g in groups]
    # a tree's open nodes lie side by side
    spans = [(t, *np.searchsorted(growth.tree_of, [t, t + 1]).tolist()) for t in np.unique(growth.tree_of).tolist()]
    total = None
    for b in blocks:
        if total is None:
            total = {t: [np.zeros((3, (end - first) * c)) for c in cells] for t, first, end in spans}
        for t, first, end in spans:
            m, width = growth.model[t], end - first
            slot = slot_of[walk(arrays, b.bins, growth.roots[t], growth.depth)]
            at = np.flatnonzero((slot >= 0) & b.taken[m])
            g, h = _gradients(growth.params[m], b.margin[m][at], b.y[at], 1.0)
            slot = slot[at] - first
            for code, c, out in zip(b.codes, cells, total[t]):
                cell = slot * c + code[at]
                out[0] += np.bincount(cell, g, width * c)
                out[1] += np.bincount(cell, h, width * c)
                out[2] += np.bincount(cell, minlength=width * c)
    if total is None:
        return
    out = np.zeros((3, growth.chosen.shape[1], slots, n_bins))
    for t, first, end in spans:
        # all nodes of a booster's tree have the same features to choose from
        chosen = growth.chosen[first].tolist()
        for group, sums in zip(groups, total[t]):
            sums = sums.reshape(3, end - first, *(sizes[f] for f in group))
            for i, f in enumerate(group):
                one = sums.sum(tuple(2 + j for j in range(len(group)) if j != i))
                for k in (k for k, c in enumerate(chosen) if c == f):
                    out[:, k, first:end, : sizes[f]] = one
    yield out


def _advance(blocks: Iterator[Held], shared) -> Iterator[Held]:
    """Blocks with the margins of one more tree a model, and the rows of the next round."""
    arrays, grown, levels, params, turn = shared.value
    for b in blocks:
        b.margin = b.margin.copy()
        for m, root in grown:
            b.margin[m] += params[m].rate * arrays[4][walk(arrays, b.bins, root, levels)]
        yield b.taking(params, turn)


def _added(sums: RDD) -> np.ndarray | None:
    """The tasks' sums as one."""
    parts = [sums.treeReduce(np.add)] if sums.getNumPartitions() > DRIVER_SUMS else sums.collect()
    return np.sum(parts, 0) if parts else None


def one_tree(t: Trees, root: int) -> dict:
    """A tree of several, with nodes counted from its own root."""
    nodes, level = [], [root]
    while level:
        nodes += level
        level = [c for n in level if t.low[n] >= 0 for c in (int(t.low[n]), int(t.high[n]))]
    place = {n: i for i, n in enumerate(nodes)} | {-1: -1}
    child = lambda a: [place[c] for c in a[nodes].tolist()]
    return {"feature": t.feature[nodes].tolist(), "bound": t.bound[nodes].tolist(), "low": child(t.low), "high": child(t.high), "value": t.value[nodes].tolist()}


def as_dict(t: Trees) -> dict:
    return {"feature": t.feature.tolist(), "bound": t.bound.tolist(), "low": t.low.tolist(), "high": t.high.tolist(), "value": t.value.tolist()}


def _whole(batches: Iterator[pa.RecordBatch], params: TreeParams, features: int, n_bins: int) -> Iterator[pa.RecordBatch]:
    """All trees of a table that is one block."""
    for batch in batches:
        for r in batch.to_pylist():
            bins, y, key, _ = _read(r, features)
            grown: list = []
            margins(bins, y, key, [params], np.ones((1, len(y)), bool), [[params.rounds]], n_bins, grown)
            yield pa.record_batch([pa.array([json.dumps([as_dict(g.trees) for _, g in grown])])], names=["trees"])


def fit_boosted(df: DataFrame, features: list[str], params: TreeParams, label: str = "cardio", key: str = "id", bins: int = BINS) -> BoostedModel:
    """A booster over all rows of a table, however large.

    The binned rows are held in blocks, dealt out evenly; a level of a tree is one
    pass over them (a task's sums come back, as many as there are cores), the leaves
    of the last level follow from the sums above them, and a finished tree is
    broadcast and added to the blocks' margins as the next round's first level reads
    them. Only the round's blocks stay cached; every WRITE_EVERY rounds they are
    written to the checkpoint folder. Where one block holds all rows its own sums are
    the totals, and its task grows all trees.
    """
    if params.kind == "forest":
        raise ValueError("a forest is not boosted")
    from vitalframe.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    edges = bin_edges(df, features, bins)
    positive = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    start = start_margin(params, 0.5 if positive is None else positive)
    rows = df.select(F.xxhash64(F.col(key)).alias("key"), F.col(label).cast("double"), *[F.col(c).cast("double") for c in features])
    few = rows.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS
    if few:
        got = rows.coalesce(1).mapInArrow(partial(_blocks, edges=edges, start=start), _BLOCK).checkpoint().mapInArrow(partial(_whole, params=params, features=len(features), n_bins=bins), "trees string").collect()
        return BoostedModel(features, edges, start, params.rate, json.loads(got[0][0]) if got else [])
    written = written_blocks(df, features, edges, start, label, key)
    return BoostedModel(features, edges, start, params.rate, grow_over(written, edges, [params], bins)[0])


def written_blocks(df: DataFrame, features: list[str], edges: list[list[float]], start: float, label: str = "cardio", key: str = "id") -> DataFrame:
    """A table's rows as binned blocks, dealt out evenly and written to the checkpoint folder."""
    rows = df.select(F.xxhash64(F.col(key)).alias("key"), F.col(label).cast("double"), *[F.col(c).cast("double") for c in features])
    return rows.mapInArrow(partial(_blocks, edges=edges, start=start), _BLOCK).repartition(df.sparkSession.sparkContext.defaultParallelism).checkpoint()


def grow_over(written: DataFrame, edges: list[list[float]], params: list[TreeParams], bins: int = BINS) -> list[list[dict]]:
    """The trees of boosters of one depth that are grown together over written blocks; a pass a level serves all of them."""
    sc = written.sparkSession.sparkContext
    depth = params[0].depth
    if any(p.kind == "forest" or p.depth != depth for p in params):
        raise ValueError("boosters of one depth are grown together")
    sizes = [len(e) + 1 for e in edges]
    groups = packs(sizes)
    state = written.rdd.mapPartitions(partial(_held, p=params, groups=groups, sizes=sizes)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    out: list[list[dict]] = [[] for _ in params]
    before, used, rounds = None, [], max(p.rounds for p in params)
    for turn in range(rounds):
        live = [m for m, p in enumerate(params) if turn < p.rounds]
        growth, more = Growth(params, np.array(live), turn, len(edges)), True
        while more:
            shared = sc.broadcast((growth, groups, sizes, bins))
            sums = _added(state.mapPartitions(partial(_level, shared=shared)))
            shared.unpersist()
            if before is not None:  # read by this round's first level
                before.unpersist()
                before = None
            more = growth.split(sums)
            if more and growth.depth == depth:
                growth.close(sums)
                more = False
        grown = list(zip(live, growth.roots.tolist()))
        for m, root in grown:
            out[m].append(one_tree(growth.trees, root))
        if turn + 1 < rounds:
            # a lost block is made again from the last written ones, by the trees since then
            used.append(sc.broadcast((growth.trees.arrays(), grown, depth, params, turn + 1)))
            before, state = state, state.mapPartitions(partial(_advance, shared=used[-1])).persist(StorageLevel.MEMORY_AND_DISK_DESER)
            if (turn + 1) % WRITE_EVERY == 0:
                state.checkpoint()
                state.count()
                before.unpersist()
                before = None
                while used:
                    used.pop().unpersist()
    state.unpersist()
    return out


def held_out_scores(rows: DataFrame, features: list[str], edges: list[list[float]], start: float, grown: list[tuple[float, list[dict], dict[int, list[int]]]], label: str = "cardio") -> DataFrame:
    """(trial, label, probability) of every row and booster: (rate, trees, trials by their number of trees) each."""
    shared = rows.sparkSession.sparkContext.broadcast((edges, start, [(rate, [_arrays(t) for t in trees], report) for rate, trees, report in grown]))
    return rows.select(F.col(label).cast("int"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]).mapInArrow(partial(_trial_scores, shared=shared), "trial int, label int, probability double")


def _arrays(tree: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.array(tree[k], float if k == "value" else np.int64) for k in ("feature", "bound", "low", "high", "value"))


def _trial_scores(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    edges, start, grown = shared.value
    for batch in batches:
        x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, batch.num_columns)], 1)
        bins = to_bins(x, edges)
        for rate, trees, report in grown:
            margin = np.full(len(x), start)
            for k in range(max(report)):
                if k < len(trees):
                    margin += rate * trees[k][4][descend(trees[k], bins, np.zeros((1, len(x)), np.int64))[0]]
                for trial in report.get(k + 1, []):
                    yield pa.record_batch([pa.array(np.full(len(x), trial, np.int32)), batch.column(0), pa.array(1 / (1 + np.exp(-margin)))], names=["trial", "label", "probability"])


def _scored(batches: Iterator[pa.RecordBatch], shared, kept: int) -> Iterator[pa.RecordBatch]:
    model = shared.value
    grown = [_arrays(t) for t in model.trees]
    for batch in batches:
        x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(kept, batch.num_columns)], 1)
        bins, margin = to_bins(x, model.edges), np.full(len(x), model.start)
        for t in grown:
            margin += model.rate * t[4][descend(t, bins, np.zeros((1, len(x)), np.int64))[0]]
        yield pa.record_batch([*(batch.column(i) for i in range(kept)), pa.array(1 / (1 + np.exp(-margin)))], names=[*batch.schema.names[:kept], "probability"])


def score_boosted(df: DataFrame, model: BoostedModel, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep..., probability) of rows with the model's features, from their bins."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*keep, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(model.features)])
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(partial(_scored, shared=shared, kept=len(keep)), f"{schema}, probability double")
