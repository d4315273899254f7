"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

Learning counts, per language, the character trigrams of words (hashed into
``BUCKETS`` cells, so the table has a fixed size) and the letters of every script.
A word is a run of letters of one script; only languages that use its script are
candidates; its score for a candidate is the trigrams' log probability, less the
best candidate's, and no lower than ``FLOOR``. Viterbi labels the words of a text
so that scores minus ``SWITCH`` for each change of language are highest. Where one
label provably wins everywhere (no stretch of words gains as much as a switch
costs) the search is skipped; the labels are the same. The text's language is the
label of most letters, its score that label's share of all letters.

Defined cases: null, empty and letterless texts are ``und`` with score 0; letters
of a script that no learned language uses have no label, and a text of such
letters alone gets the most frequent language with score 0; ties go to the
language first in code point order; without labelled rows all texts are ``und``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, read_table, small_batches

#: Cells of the trigram table.
BUCKETS = 1 << 16
#: Most languages a model may have (an error beyond).
MAX_LANGUAGES = 128
#: Added to every cell's count.
SMOOTH = 0.5
#: Lowest score of a candidate for one word.
FLOOR = -8.0
#: Cost of a change of language between two words.
SWITCH = 12.0
#: A language uses a script if it holds at least this share of the language's letters.
SCRIPT_SHARE = 0.001
#: Characters handled at once; texts are cut between words.
CHUNK = 1 << 19
UNDECIDED = "und"

#: Code point ranges of scripts (first, last, script).
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x1E00, 0x1EFF, "latin"), (0x2C60, 0x2C7F, "latin"), (0xA720, 0xA7FF, "latin"), (0xFF21, 0xFF5A, "latin"),
    (0x0370, 0x03FF, "greek"), (0x1F00, 0x1FFF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x1C80, 0x1C8F, "cyrillic"), (0x2DE0, 0x2DFF, "cyrillic"), (0xA640, 0xA69F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x08A0, 0x08FF, "arabic"), (0xFB50, 0xFEFF, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"),
    (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1200, 0x139F, "ethiopic"),
    (0x1100, 0x11FF, "hangul"), (0x3130, 0x318F, "hangul"), (0xAC00, 0xD7AF, "hangul"), (0x3040, 0x30FF, "kana"), (0x31F0, 0x31FF, "kana"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xF900, 0xFAFF, "han"), (0x20000, 0x323AF, "han"),
]
#: Script 0 is no letter, 1 a letter of none of the ranges.
SCRIPT_NAMES = ["", "other", *dict.fromkeys(s for _, _, s in SCRIPTS)]


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Script number of every code point; 0 for what is no letter."""
    table = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    for first, last, name in SCRIPTS:
        table[first : last + 1] *= SCRIPT_NAMES.index(name)
    return table


class Words:
    """Words of a stretch of text as arrays: places of letters, word starts, trigram cells."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        script = script_table()[code] if len(code) else np.zeros(0, np.uint8)
        before = np.concatenate([[0], script[:-1]]).astype(np.uint8)
        self.letters = np.flatnonzero(script)
        self.script = script[self.letters]
        # a word starts where the script changes
        self.first = np.flatnonzero((script[self.letters] != before[self.letters]))
        self.size = np.diff(np.append(self.first, len(self.letters)))
        c = code[self.letters].astype(np.uint64)
        n = len(c)
        starts, ends = np.zeros(n, bool), np.zeros(n, bool)
        starts[self.first] = True
        ends[np.append(self.first[1:], n)[: len(self.first)] - 1] = True
        prev, nxt = np.where(starts, np.uint64(94), np.roll(c, 1)), np.where(ends, np.uint64(36), np.roll(c, -1))
        mixed = (prev * np.uint64(0x9E3779B97F4A7C15)) ^ (c * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (nxt * np.uint64(0x165667B19E3779F9))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.cells = (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS


def _folded(text: str) -> str:
    """The text in composed form and lower case."""
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()


def _chunks(text: str) -> Iterator[tuple[int, str]]:
    """(place, stretch) of a text, cut at spaces where there are any."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        if end < len(text):
            end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 or end
            end = end if end > at else min(len(text), at + CHUNK)
        yield at, text[at:end]
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) rows -> (lang, cell, n); cells from BUCKETS on count letters by script."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums = total.get(lang)
            if sums is None:
                sums = total[lang] = np.zeros(BUCKETS + len(SCRIPT_NAMES), dtype=np.int64)
            for _, part in _chunks(_folded(text)):
                w = Words(part)
                np.add.at(sums, w.cells, 1) if len(w.cells) < 2000 else np.add(sums[:BUCKETS], np.bincount(w.cells, minlength=BUCKETS), out=sums[:BUCKETS])
                sums[BUCKETS:] += np.bincount(w.script, minlength=len(SCRIPT_NAMES))
    for lang, sums in total.items():
        cells = np.flatnonzero(sums)
        yield pa.record_batch([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(sums[cells], pa.int64())], names=["lang", "cell", "n"])


class Model:
    """Learned tables: ``logp`` (cells x languages) and ``candidate`` (scripts x languages)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:BUCKETS].astype(float), counts[BUCKETS:].astype(float)
        self.letters = scripts.sum(axis=0)
        self.logp = np.log((grams + SMOOTH) / (grams.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32)
        self.candidate = scripts >= SCRIPT_SHARE * np.maximum(self.letters, 1.0)

    def scores(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages) scores and which words have a candidate at all."""
        total = np.add.reduceat(self.logp[w.cells], w.first, axis=0).astype(np.float64) if len(w.first) else np.zeros((0, len(self.langs)))
        may = self.candidate[w.script[w.first]]
        known = may.any(axis=1)
        total[~may] = -np.inf
        best = np.where(known, total.max(axis=1, initial=-np.inf), 0.0)
        return np.where(known[:, None], np.maximum(total - best[:, None], FLOOR), 0.0), known

    def label(self, s: np.ndarray) -> np.ndarray:
        """Viterbi labels of words from their scores."""
        n, k = s.shape
        lead = int(s.sum(axis=0).argmax())
        gain = np.zeros((n + 1, k))
        np.cumsum(s - s[:, [lead]], axis=0, out=gain[1:])
        if (gain - np.minimum.accumulate(gain, axis=0)).max() < SWITCH:
            return np.full(n, lead, dtype=np.int32)
        value, back, rows = list(s[0]), [], s.tolist()
        for row in rows[1:]:
            top = max(range(k), key=value.__getitem__)
            bar = value[top] - SWITCH
            back.append([j if value[j] >= bar else top for j in range(k)])
            value = [max(value[j], bar) + row[j] for j in range(k)]
        out = np.empty(n, dtype=np.int32)
        j = max(range(k), key=value.__getitem__)
        for i in range(n - 1, -1, -1):
            out[i] = j
            if i:
                j = back[i - 1][j]
        return out

    def spans(self, text: str) -> tuple[str, float, list[dict]]:
        """Language, score and labelled spans (places in the folded text) of a text."""
        folded, scores, sizes, places, known = _folded(text), [], [], [], []
        for at, part in _chunks(folded):
            w = Words(part)
            if len(w.first):
                s, k = self.scores(w)
                scores.append(s)
                known.append(k)
                sizes.append(w.size)
                places.append(np.stack([w.letters[w.first] + at, w.letters[np.append(w.first[1:], len(w.letters)) - 1] + at + 1], axis=1))
        if not scores or not self.langs:
            return UNDECIDED, 0.0, []
        s, size, place, k = (np.concatenate(x) for x in (scores, sizes, places, known))
        labels = self.label(s)
        votes = np.bincount(labels[k], weights=size[k], minlength=len(self.langs))
        if not votes.any():
            return self.langs[int(self.letters.argmax())], 0.0, []
        lead = int(votes.argmax())
        edge = np.flatnonzero(np.diff(labels)) + 1
        starts, stops = np.append(0, edge), np.append(edge, len(labels))
        found = [{"first": int(place[a, 0]), "last": int(place[b - 1, 1]), "lang": self.langs[labels[a]]} for a, b in zip(starts, stops)]
        return self.langs[lead], float(votes[lead] / size.sum()), found


def fit(df: DataFrame, text: Column, lang: Column) -> Model:
    """Learn from every row with a text and a language; counts are summed by Spark."""
    small_batches(df.sparkSession)
    rows = df.select(text.alias("text"), lang.alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    width = BUCKETS + len(SCRIPT_NAMES)
    table = counts.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).limit(MAX_LANGUAGES + 1).toArrow()
    if table.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = table.column("lang").to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    sums = np.zeros((width, len(names)), dtype=np.int64)
    for col, i in enumerate(order):
        cells = table.column("cells")[i].values
        sums[cells.field("cell").to_numpy(), col] = cells.field("n").to_numpy()
    return Model([names[i] for i in order], sums)


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("lang", T.StringType())]))


def identify(df: DataFrame, text: str, model: Model, out: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """Add language, score and spans (places in the lower-cased NFC text) to every row, under the names ``out``.

    The model has BUCKETS x MAX_LANGUAGES cells at most, so it is broadcast.
    """
    rows = df.drop(*[c for c in out if c != text])
    at, shared = rows.columns.index(text), df.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.spans(t) if t else (UNDECIDED, 0.0, []) for t in batch.column(at).to_pylist()]
            cols = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), span))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *out])

    schema = T.StructType([*rows.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], SPAN_TYPE)])
    return rows.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32(doc_id) mod 5 is not 0."""
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs.where(~held), F.col("text"), F.col("lang"))
    out = identify(docs.select("doc_id", held.alias("held_out"), "text"), "text", model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Pipeline stage: documents with a language that labels at least ``least`` of their letters.

    Learns from the stage's own documents with a ``lang``; ``lang`` itself is kept as given.
    """
    model = fit(docs, F.col("text"), F.col("lang"))
    names = tuple(free_names(docs.columns, "lang_pred", "lang_score", "lang_spans"))
    found = identify(docs, "text", model, names)
    return found.where((F.col(names[0]) != UNDECIDED) & (F.col(names[1]) >= least)).select(*docs.columns)
