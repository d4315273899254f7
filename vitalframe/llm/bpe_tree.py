"""BPE encoding by tree concatenation, and decoding.

A text up to ``LEAF`` characters is encoded at once. A longer one is cut at
equal distances, wherever that falls, and its pieces are encoded by different
tasks. Neighbouring encodings are then joined pairwise up a tree: the window
around the join, from a token start of the left side to a token end of the right
side, is encoded again, and the sides agree where a run of ``AGREE`` tokens with
the same ids and the same places occurs in both the window and the side. The
left side is kept up to that run, then the window, then the right side from its
run on. Without agreement on both sides the window doubles, at most to all of
both sides, which is then exact by itself.

Why agreement is exact: a token sequence is the encoding of its text if every
pair of neighbours is the encoding of the pair's text. Pairs before the run are
neighbours in the left encoding, pairs after it in the window. Cuts by the
pre-tokenizer look a few characters ahead only, and agreement within ``MARGIN``
characters of a window's open end does not count.

Defined cases: null counts as empty text and gives no ids; repeated rows are
encoded as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches
from .encoders import MEMORY

#: Pre-tokens a worker remembers in the pipeline: workers live on into the next stages, which need the room.
STAGE_MEMORY = 100_000
#: Characters of a leaf.
LEAF = 32_768
#: Characters of the first window on each side of a join.
WINDOW = 64
#: Tokens in a row that must agree.
AGREE = 2
#: Characters at an open end of a window where agreement does not count.
MARGIN = 16


class Part:
    """A stretch of text with its tokens: ids and their places, counted from the stretch's start."""

    def __init__(self, text: str, ids: list, spans: list):
        self.text, self.ids, self.spans = text, ids, spans

    @classmethod
    def of(cls, tok, text: str) -> "Part":
        e = tok.encode(text, add_special_tokens=False)
        return cls(text, e.ids, e.offsets)


def _runs(ids: list, spans: list, shift: int, low: int, high: int) -> dict:
    """(ids, places) of every run of AGREE tokens within [low, high] -> index of the run's first token."""
    out = {}
    for i in range(len(ids) - AGREE + 1):
        a, b = spans[i][0] + shift, spans[i + AGREE - 1][1] + shift
        if a >= low and b <= high:
            out[tuple((ids[j], spans[j][0] + shift, spans[j][1] + shift) for j in range(i, i + AGREE))] = i
    return out


def join(tok, left: Part, right: Part, window: int = WINDOW) -> Part:
    """The encoding of ``left.text + right.text`` from the two encodings and windows around the join."""
    text, mid = left.text + right.text, len(left.text)
    while True:
        # from a token start of the left side, to a token end of the right side
        i = next((k for k in range(len(left.ids) - 1, 0, -1) if left.spans[k][0] <= mid - window and left.spans[k - 1][1] <= left.spans[k][0]), 0)
        j = next((k for k in range(len(right.ids) - 1) if right.spans[k][1] >= window and right.spans[k + 1][0] >= right.spans[k][1]), len(right.ids) - 1)
        a = left.spans[i][0] if i > 0 else 0
        b = mid + right.spans[j][1] if 0 <= j < len(right.ids) - 1 else len(text)
        mend = Part.of(tok, text[a:b])
        if (a, b) == (0, len(text)):
            return mend
        low, high = (a + MARGIN if a else 0), (b - MARGIN if b < len(text) else b)
        seen = _runs(mend.ids, mend.spans, a, low, high)
        before, after = (0, 0), (len(mend.ids), len(right.ids))
        if a:
            mine = _runs(left.ids[i:], left.spans[i:], 0, low, mid)
            found = [(mine[k] + i, seen[k]) for k in mine if k in seen]
            before = min(found, default=None)
        if b < len(text):
            theirs = _runs(right.ids[: j + 1], right.spans[: j + 1], mid, mid, high)
            found = [(seen[k], theirs[k]) for k in theirs if k in seen]
            after = max(found, default=None)
        if before is not None and after is not None and before[1] <= after[0]:
            (l0, w0), (w1, r1) = before, after
            ids = left.ids[:l0] + mend.ids[w0:w1] + right.ids[r1:]
            spans = left.spans[:l0] + [(x + a, y + a) for x, y in mend.spans[w0:w1]] + [(x + mid, y + mid) for x, y in right.spans[r1:]]
            return Part(text, ids, spans)
        window *= 2


def concatenate(tok, parts: list[Part]) -> Part:
    """Join neighbours pairwise until one part is left."""
    while len(parts) > 1:
        parts = [join(tok, parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in small pieces, so that a worker holds few texts and results at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids as bytes -> number and list of ids."""
    for batch in batches:
        raw = batch.column(1).to_pylist()
        at = np.zeros(len(raw) + 1, np.int32)
        np.cumsum([len(r) // 4 for r in raw], out=at[1:])
        ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), np.int32)))
        yield pa.record_batch([batch.column(0), pa.array(np.diff(at).astype(np.int64)), ids], names=["doc_id", "n_tokens", "ids"])


def _whole_listed(batches: Iterator[pa.RecordBatch], vocabulary: str, memory: int) -> Iterator[pa.RecordBatch]:
    """Short texts: (doc, n_tokens, ids as a list)."""
    return _listed(_whole(batches, vocabulary, memory))


def _whole(batches: Iterator[pa.RecordBatch], vocabulary: str, memory: int) -> Iterator[pa.RecordBatch]:
    """Short texts: (doc, ids)."""
    from .encoders import encoder
    from .encoders import vocabulary as find

    enc = encoder(find(vocabulary), memory)
    for batch in _slices(batches):
        yield pa.record_batch([*batch.columns[:-1], pa.array([enc.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())],
                              names=[*batch.schema.names[:-1], "ids"])


def _leaf(batches: Iterator[pa.RecordBatch], vocabulary: str, memory: int) -> Iterator[pa.RecordBatch]:
    """Pieces of long texts: ids and places beside the piece's text."""
    from .encoders import encoder
    from .encoders import vocabulary as find

    tok = encoder(find(vocabulary), memory).tok  # the one that short texts use
    for batch in batches:
        for k in range(batch.num_rows):
            part = Part.of(tok, batch.column(2)[k].as_py())
            spans = array("I", [x for s in part.spans for x in s]).tobytes()
            yield pa.record_batch([batch.column(c).slice(k, 1) for c in range(3)] + [pa.array([array("I", part.ids).tobytes()]), pa.array([spans])],
                                  names=["row", "k", "text", "ids", "spans"])


def _tree(pdf: pd.DataFrame, vocabulary: str, memory: int, lists: bool) -> pd.DataFrame:
    """All pieces of one text -> its ids, as bytes or as their number and list."""
    from .encoders import encoder
    from .encoders import vocabulary as find

    tok = encoder(find(vocabulary), memory).tok
    parts = []
    for t, i, s in pdf.sort_values("k")[["text", "ids", "spans"]].itertuples(index=False):
        flat = array("I", s).tolist()
        parts.append(Part(t, array("I", i).tolist(), list(zip(flat[::2], flat[1::2]))))
    row, ids = pdf["row"].iloc[0], concatenate(tok, parts).ids
    if lists:
        return pd.DataFrame({"row": [row], "n_tokens": [len(ids)], "ids": [np.array(ids, np.int32)]})
    return pd.DataFrame({"row": [row], "ids": [array("I", ids).tobytes()]})


def encode(df: DataFrame, doc_id: Column, text: Column, vocabulary: str = "word_bpe_49k.json", leaf: int = LEAF, memory: int = MEMORY, lists: bool = False) -> DataFrame:
    """(doc_id, ids) of every row; ids as little-endian unsigned 32-bit integers.

    With ``lists``, (doc_id, n_tokens, ids) with ids as an array. The step that
    encodes makes it: a Python step of its own would keep a second worker a core.
    ``leaf`` only moves work between tasks, and ``memory`` (pre-tokens that a
    worker remembers) only saves some of it; any values give the same ids.
    """
    small_batches(df.sparkSession)
    found = "n_tokens long, ids array<int>" if lists else "ids binary"
    body = F.coalesce(text, F.lit(""))
    rows = df.select(doc_id.cast("long").alias("doc_id"), body.alias("text"))
    short = rows.where(F.length("text") <= leaf).mapInArrow(partial(_whole_listed if lists else _whole, vocabulary=vocabulary, memory=memory), f"doc_id long, {found}")
    long = rows.where(F.length("text") > leaf).withColumn("row", F.struct("doc_id", F.monotonically_increasing_id().alias("n")))
    count = F.ceil(F.length("text") / F.lit(leaf)).cast("int")
    pieces = long.select(F.to_json("row").alias("row"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"), "text")
    pieces = pieces.select("row", "k", F.expr(f"substring(text, k * {leaf} + 1, {leaf})").alias("text"))
    # spread the pieces, whichever rows they come from, before the work on them
    leaves = pieces.repartition("row", "k").mapInArrow(partial(_leaf, vocabulary=vocabulary, memory=memory), "row string, k int, text string, ids binary, spans binary")
    joined = leaves.groupBy("row").applyInPandas(partial(_tree, vocabulary=vocabulary, memory=memory, lists=lists), f"row string, {found}")
    return short.unionByName(joined.select(F.get_json_object("row", "$.doc_id").cast("long").alias("doc_id"), *joined.columns[1:]))


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """doc_id, ids -> digests of the ids and of the decoded text."""
    from .encoders import encoder
    from .encoders import vocabulary as find

    tok = encoder(find(vocabulary)).tok
    for batch in _slices(batches):
        n, by_id, by_text = [], [], []
        for raw in batch.column(1).to_pylist():
            ids = array("I", raw).tolist()
            n.append(len(ids))
            by_id.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            by_text.append(hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(by_id, pa.string()), pa.array(by_text, pa.string())],
                              names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _texts(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    from .encoders import encoder
    from .encoders import vocabulary as find

    tok = encoder(find(vocabulary)).tok
    for batch in _slices(batches):
        out = [tok.decode(array("I", raw).tolist(), skip_special_tokens=False) for raw in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def decode(tokens: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return tokens.select("doc_id", "ids").mapInArrow(partial(_texts, vocabulary=vocabulary), "doc_id long, text string")


def digest(tokens: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) from (doc_id, ids); the text is decoded in full."""
    return tokens.select("doc_id", "ids").mapInArrow(partial(_decode, vocabulary=vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    docs = read_table(spark, sf_dir, "documents")
    return digest(encode(docs, F.col("doc_id"), F.col("text")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: (doc_id, n_tokens, ids) of every document."""
    return encode(docs, F.col("doc_id"), F.col("text"), memory=STAGE_MEMORY, lists=True)
