"""Toxicity: noisy-channel deobfuscation, then a word-weight classifier.

A character language model is counted over all documents: ``P(c | a, b)`` over a
fixed alphabet of 64 symbols (a dense table of 64 ** 3 cells, whatever the
input's size). Tokens that look disguised are decoded: each input character is an
edge or several in a lattice (a leetspeak sign may stand for letters, a separator
or repeated letter may be dropped, a separator may end a word), each edge has a
channel cost, and Viterbi finds the restored text of least channel plus language
model cost. Ordinary words are left as they are.

The distinct restored words of a document and their first letters (hashed) are
its features. Every labelled training row is counted; a word's weight is the
shrunk log odds ratio of toxic and other documents that hold it. A small logistic
fit on the strongest weights of a document (each training row without its own
counts), over ``FIT_ROWS`` rows at most, turns weights into a probability.

Defined cases: null and empty texts have no words and get the fit's score for
none; a document labelled more than once is counted for each distinct label;
null labels do not count; without both labels all scores are the toxic share.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, maybe_in, read_table

#: Symbol 0 is a word's edge, 1 any other letter, then these.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SYMBOLS = 64
#: Signs that stand for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
        "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c"}
#: Channel costs: a sign read as a letter; a dropped digit (or a word end for it), mark or letter (doubled, or of a longer run); a word end for a mark.
COST_LEET, COST_DROP_DIGIT, COST_DROP_MARK, COST_DROP_DOUBLE, COST_DROP_RUN, COST_END = 0.5, 3.0, 0.4, 1.5, 0.2, 1.0
#: Cells of the word-weight table.
CELLS = 1 << 20
#: Leading letters that are a feature of their own.
PREFIX = 5
#: Prior documents of a word's odds.
SHRINK = 2.0
#: Most training rows of the logistic fit, chosen by hash of the id; the counts behind it use every row.
FIT_ROWS = 50_000
#: Strongest weights per kind that are inputs of the fit.
TOP = 3
#: Tokens a worker remembers.
MEMORY = 400_000
#: Characters handled at once; longer texts are cut between words.
CHUNK = 1 << 20

#: Three or more single characters parted by marks, within quotes, brackets or before closing punctuation.
_SPACED = re.compile(r"""(?<!\S)["'`(\[{<«“]*((?:[^\s.\-_*][ \t.\-_*]{1,5}){2,}[^\s.\-_*])(?=[.,;:?!"'`)\]}>»”…*_-]*(?!\S))""")
_DOUBLE = re.compile(r"(.)\1")
#: Marks around a token that stand for no letter.
_EDGE = ".,;:?\"'`)]}>«»…“”[{<*&#%_-"
_CLOSING = ".,;:?\"'`)]}>»«…“”"
_DOUBLES = re.compile(r"([^\W\d_])\1")
_WORD = re.compile(r"[^\W\d_]+")


def symbol_table() -> np.ndarray:
    """Symbol of every code point of the Basic Multilingual Plane; other planes count as other letters."""
    table = np.fromiter((1 if chr(i).isalpha() else 0 for i in range(1 << 16)), dtype=np.uint8, count=1 << 16)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 2
    return table


def symbol(c: str) -> int:
    at = ALPHABET.find(c)
    return at + 2 if at >= 0 else int(c.isalpha())


def _add_trigrams(total: np.ndarray, table: np.ndarray, tokens: Counter) -> None:
    """Count the trigrams of distinct tokens, each as often as it occurred."""
    if not tokens:
        return
    code = np.frombuffer((" " + " ".join(tokens) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = np.where(code < 1 << 16, table[np.minimum(code, (1 << 16) - 1)], 1).astype(np.int64)
    times = np.repeat(np.fromiter(tokens.values(), np.float64, len(tokens)), np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens)))
    c, b = s[1:], s[:-1]
    a = np.where(b == 0, 0, np.concatenate([[0], b[:-1]]))
    here = (b != 0) | (c != 0)
    total += np.bincount((a[here] * SYMBOLS + b[here]) * SYMBOLS + c[here], weights=times[here], minlength=SYMBOLS**3).astype(np.int64)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """texts -> (cell, n) of all trigrams within words and their edges."""
    table, total, tokens = symbol_table(), np.zeros(SYMBOLS**3, dtype=np.int64), Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            tokens.update(text.lower().split())
            if len(tokens) > MEMORY:
                _add_trigrams(total, table, tokens)
                tokens.clear()
    _add_trigrams(total, table, tokens)
    cells = np.flatnonzero(total)
    yield pa.record_batch([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], names=["cell", "n"])


class CharModel:
    """-log P(c | a, b), interpolated with P(c | b)."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        bi = tri.sum(axis=0)
        p2 = (bi + 1.0) / (bi.sum(axis=1, keepdims=True) + SYMBOLS)
        p3 = (tri + 5.0 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5.0)
        self.cost = -np.log(p3).astype(np.float32)

    def decode(self, noisy: str) -> str:
        """The likeliest restored text (words parted by a space) of a noisy string."""
        return self.best(noisy)[1].strip()

    def best(self, noisy: str, drop: bool = True) -> tuple[float, str]:
        """Cost and text of the lattice's best path; without ``drop`` every sign for letters is one."""
        cost = self.cost
        # state (a, b) -> (cost, what was put out last with what came before it)
        best: dict = {(0, 0): (0.0, None)}
        run, last = 0, ""
        for i, ch in enumerate(noisy):
            run, last = run + 1 if ch == last else 1, ch
            long_run = run > 2 or (run == 2 and i + 1 < len(noisy) and noisy[i + 1] == ch)
            # (letter or "" to drop or " " to end the word, channel cost)
            if ch.isalpha():
                edges = [(ch, 0.0)]
                if run > 1:
                    edges.append(("", COST_DROP_RUN if long_run else COST_DROP_DOUBLE))
            else:
                edges = [(c, COST_LEET) for c in LEET.get(ch, "")]
                if drop or not edges:
                    edges += [("", COST_DROP_DIGIT), (" ", COST_DROP_DIGIT)] if ch.isdigit() else [("", COST_DROP_MARK), (" ", COST_END)]
            nxt: dict = {}
            for (a, b), (so_far, text) in best.items():
                for out, channel in edges:
                    if out == "":
                        key, total, grown = (a, b), so_far + channel, text
                    elif out == " ":
                        key, total, grown = (0, 0), so_far + channel + (float(cost[a, b, 0]) if b else 0.0), (text, " ") if b else text
                    else:
                        c = symbol(out)
                        key, total, grown = (b, c), so_far + channel + float(cost[a, b, c]), (text, out)
                    if key not in nxt or total < nxt[key][0]:
                        nxt[key] = (total, grown)
            best = nxt
        ends = [(s + (float(cost[a, b, 0]) if b else 0.0), t) for (a, b), (s, t) in best.items()]
        least = min(s for s, _ in ends)
        return least, min(_written(t) for s, t in ends if s == least)


def _written(text: tuple | None) -> str:
    """The letters of a path, which holds them last first."""
    out = []
    while text:
        text, c = text
        out.append(c)
    return "".join(reversed(out))


def disguised(token: str) -> bool:
    """Whether a token is worth decoding: letters mixed with signs for letters or with marks, or a letter doubled."""
    if token.isalpha():
        return bool(_DOUBLES.search(token))
    core = token.strip(_CLOSING)
    inner = core.strip("!*&#%$_-|+")
    return any(c.isalpha() for c in core) and (any(c in LEET for c in core) or not inner.isalpha() or bool(_DOUBLES.search(inner)))


def signs_for_letters(token: str) -> str:
    """The signs of a token that is made of signs for letters alone (three or more, not all alike, no digit), or nothing."""
    core = token.strip(_CLOSING)
    for signs in (core.rstrip("!"), core):
        if len(signs) > 2 and len(set(signs)) > 1 and all(c in LEET and not c.isdigit() for c in signs):
            return signs
    return ""


class Restorer(dict):
    """token -> its restored words; remembers what it has decoded."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def restored(self, token: str) -> tuple:
        core = token.strip(_EDGE)
        if core.isalpha() and not _DOUBLE.search(core):
            return (core,)
        if signs := signs_for_letters(token):
            return tuple(self.model.best(signs, drop=False)[1].split())
        return tuple(self.model.decode(token).split() if disguised(token) else _WORD.findall(token))

    def __missing__(self, token: str):
        if len(self) >= MEMORY:
            self.clear()
        got = self[token] = self.made_of(self.restored(token))
        return got

    @staticmethod
    def made_of(words: tuple):
        """What is remembered of a token's restored words."""
        return words

    def tokens(self, text: str) -> Iterator[tuple[list, str | None]]:
        """The text's tokens in order, in lists, each list followed by a stretch of spaced-out letters or None."""
        text = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
        at = 0
        while at < len(text):
            end = min(len(text), at + CHUNK)
            if end < len(text):
                end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1
                end = end if end > at else min(len(text), at + CHUNK)
            part, done = text[at:end], 0
            for m in _SPACED.finditer(part):
                if sum(c.isalpha() for c in m.group(1)) >= 3:
                    yield part[done : m.start()].split(), " ".join(m.group(1).split())
                    done = m.end()
            yield part[done:].split(), None
            at = end

    def words(self, text: str) -> Iterator[tuple]:
        """What is remembered of each token of a text, in order."""
        for tokens, spaced in self.tokens(text):
            yield from map(self.__getitem__, tokens)
            if spaced is not None:
                yield self.made_of(tuple(self.model.decode(spaced).split()))


class CellRestorer(Restorer):
    """token -> hashed cells of its restored words and their first letters."""

    @staticmethod
    def made_of(words: tuple) -> tuple:
        return tuple({crc32(w.encode()) % CELLS for w in words} | {CELLS + crc32(w[:PREFIX].encode()) % CELLS for w in words if len(w) > PREFIX})

    def cells(self, text: str) -> list[int]:
        """The distinct cells of a text."""
        found: set = set()
        for tokens, spaced in self.tokens(text):
            found.update(*map(self.__getitem__, set(tokens)))
            if spaced is not None:
                found.update(self.made_of(tuple(self.model.decode(spaced).split())))
        return sorted(found)


def learn_characters(df: DataFrame, text: Column) -> CharModel:
    """Count the language model over every text of ``df``."""
    rows = df.select(text.alias("text")).where("text is not null")
    counts = rows.mapInArrow(_trigrams, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    dense = np.zeros(SYMBOLS**3, dtype=np.int64)
    dense[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    return CharModel(dense)


def restore(df: DataFrame, text: str, model: CharModel, out: str = "restored") -> DataFrame:
    """Add the restored, lower-cased text (tokens parted by single spaces); null stays null."""
    rows = df.drop(*({out} - {text}))
    at, shared = rows.columns.index(text), df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            texts = [None if t is None else " ".join(w for words in restorer.words(t) for w in words) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def features(df: DataFrame, doc_id: Column, text: Column, model: CharModel) -> DataFrame:
    """(doc_id, cells): the distinct hashed words and leading letters of every restored text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = CellRestorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = [restorer.cells(t or "") for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "cells"])

    return df.select(doc_id.alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, cells array<int>")


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cells, label) -> (cell, toxic, other) documents of a task; the last cell counts documents."""
    sums = np.zeros((2, 2 * CELLS + 1), dtype=np.int64)
    for batch in batches:
        for cells, label in zip(batch.column(0), batch.column(1).to_pylist()):
            sums[label, cells.values.to_numpy()] += 1
            sums[label, -1] += 1
    cells = np.flatnonzero(sums.any(axis=0))
    yield pa.record_batch([pa.array(cells, pa.int32()), pa.array(sums[1, cells]), pa.array(sums[0, cells])], names=["cell", "toxic", "other"])


class Weights:
    """Counts by cell, the fit, and their scores."""

    def __init__(self, toxic: np.ndarray, other: np.ndarray):
        self.toxic, self.other = toxic, other
        self.coef, self.mean, self.scale = None, None, None

    def inputs(self, cells: np.ndarray, label: int | None = None) -> list[float]:
        """Inputs of the fit; with a label, as if the document had not been counted."""
        a, b = self.toxic[cells] - (label == 1), self.other[cells] - (label == 0)
        n1, n0 = self.toxic[-1] - (label == 1), self.other[-1] - (label == 0)
        share = n1 / max(n1 + n0, 1)
        w = np.log((a + SHRINK * share + 1e-9) / (b + SHRINK * (1 - share) + 1e-9)) - math.log((n1 + 1e-9) / (n0 + 1e-9))
        out = []
        for part in (w[cells < CELLS], w[cells >= CELLS]):
            top = np.zeros(TOP + 2)
            part = np.sort(part)[::-1][: TOP + 2]
            top[: len(part)] = part
            out += [*top[:TOP], float(top.mean())]
        return [*out, math.log1p(len(cells))]

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        ridge = np.r_[np.ones(x.shape[1]), 1e-6]
        w = np.zeros(a.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9), a.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.coef = w

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.coef is None:
            n1, n0 = int(self.toxic[-1]), int(self.other[-1])
            return np.full(len(docs), n1 / (n1 + n0) if n1 + n0 else 0.0)
        x = np.array([self.inputs(c) for c in docs]).reshape(len(docs), -1)
        return 1 / (1 + np.exp(-np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.coef, -30, 30)))


def learn(found: DataFrame, labels: DataFrame) -> Weights:
    """Weights from (doc_id, cells) and (doc_id, toxic) rows."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").distinct()
    # only rows that a filter of fixed size lets through are shuffled; a merge join at every size
    train = found.where(maybe_in(known.select("doc_id"))(F.col("doc_id"))).join(known.hint("merge"), "doc_id")
    train = keep(train.select("doc_id", "cells", "toxic", F.xxhash64("doc_id").alias("h")), "toxic-train")
    counts = train.select("cells", "toxic").mapInArrow(_cell_counts, "cell int, toxic long, other long").groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()
    dense = np.zeros((2, 2 * CELLS + 1), dtype=np.int32)
    at = counts.column("cell").to_numpy()
    dense[0, at], dense[1, at] = counts.column("toxic").to_numpy(), counts.column("other").to_numpy()
    weights = Weights(dense[0], dense[1])
    if not dense[:, -1].all():
        return weights
    shared = found.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels_ = batch.column(2).to_pylist()
            x = [shared.value.inputs(c.values.to_numpy(), y) for c, y in zip(batch.column(1), labels_)]
            yield pa.record_batch([batch.column(0), pa.array(x, pa.list_(pa.float64())), pa.array(labels_, pa.int32())], names=["doc_id", "x", "y"])

    # by hash of the id, so the choice does not depend on the table's order
    last = train.select("h").orderBy("h").limit(FIT_ROWS).agg(F.max("h")).first()[0]
    sample = train.where(F.col("h") <= F.lit(last)).select("doc_id", "cells", "toxic")
    rows = sample.mapInArrow(run, "doc_id long, x array<double>, y int").orderBy("doc_id", "y").toArrow()
    weights.fit(np.array(rows.column("x").to_pylist()), rows.column("y").to_numpy().astype(float))
    return weights


def score(found: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, score) of every (doc_id, cells) row. The table of weights has 2 * CELLS + 1 cells, so it is broadcast."""
    shared = found.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores([c.values.to_numpy() for c in batch.column(1)])
            yield pa.record_batch([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return found.select("doc_id", "cells").mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled ones whose crc32(doc_id) mod 3 is not 1."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    chars = learn_characters(docs, F.col("text"))
    found = keep(features(docs, F.col("doc_id"), F.col("text"), chars), "toxic-cells")
    weights = learn(found, labels.where(~held))
    return score(found, weights).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
