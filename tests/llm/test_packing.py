"""op13: every id in exactly one piece, no padding, checksums against the library, the program against all patterns."""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalframe.llm import packing
from vitalframe.llm.encoders import vocabulary

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    return lambda text: array("I", [*tok.encode(text or "", add_special_tokens=False).ids, 0])


def check(pieces, rows, library, capacity=1024):
    """Whole results: pieces tile every document and every sequence, without padding."""
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append(library(text))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for doc_id, texts in want.items():
        ids = {len(t): t for t in texts}
        spots = defaultdict(int)
        for p in by_doc[doc_id]:
            assert p.ids_crc32 in {zlib.crc32(t[p.start : p.start + p.length].tobytes()) for t in texts} and p.doc_tokens in ids and p.length > 0
            for k in range(p.start, p.start + p.length):
                spots[k] += 1
        for k, n in spots.items():
            assert n == sum(k < len(t) for t in texts)
        assert sum(spots.values()) == sum(map(len, texts))
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == capacity or at & (at - 1) == 0
    return by_sequence


def run(spark, rows, capacity=1024, parts=3, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if extra:
        df = df.withColumns({"uid": F.lit("x"), "n": F.lit("y"), "size": F.lit(1), "bucket": F.lit(None).cast("int"), "ids": F.lit("z")})
    return packing.pack(packing.tokens(df, F.col("doc_id"), F.col("text"), capacity=capacity), capacity).collect()


def test_query_packs_the_whole_table(spark, library):
    from tests.conftest import SF001

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    df = packing.op13_packing(spark, SF001)
    assert df.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(df.collect(), rows, library)


@pytest.mark.parametrize("buckets", [65536, 10])
def test_odd_rows(spark, library, monkeypatch, buckets):
    monkeypatch.setattr(packing, "BUCKET_ROWS", buckets)
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same " * 9), (3, "same " * 9), (3, "same " * 9), (4, "x" * 60_000), (5, "a b c " * 3_000), (6, "é\U00010400 \x00 ẞ")]
    rows += [(i, "word " * (i % 61)) for i in range(100, 400)]
    check(run(spark, rows, capacity=64, extra=True), rows, library, 64)


def test_one_length_for_a_third(spark, library):
    rows = [(i, "the " * (690 if i % 3 == 0 else i % 97 + 1)) for i in range(240)]
    check(run(spark, rows), rows, library)


def test_empty_table_and_whole_runs(spark, library):
    assert run(spark, []) == []
    rows = [(i, ("the " * 1023).strip()) for i in range(4)]
    assert len(check(run(spark, rows), rows, library)) == 4


def test_knapsacks_against_all_multisets():
    lengths, price = np.array([2, 3, 5, 7]), np.array([1.0, 1.7, 3.1, 4.2])
    best, last = packing._knapsacks(price, lengths, 16)
    for total in range(17):
        worth = [np.dot(n, price) for n in itertools.product(range(9), repeat=4) if np.dot(n, lengths) == total]
        assert best[total] == pytest.approx(max(worth)) if worth else best[total] == -np.inf
        if worth:
            assert packing._pattern(total, last, lengths) @ lengths == total


def test_program_reaches_the_optimum():
    # a perfect packing exists: 16 = 9 + 7 = 5 + 11 = 3 + 3 + 10 = 13 + 3
    lengths, counts = np.array([3, 5, 7, 9, 10, 11, 13]), np.array([70, 40, 50, 50, 30, 40, 10])
    use, x = packing.solve(lengths, counts, 16, gap=0)
    assert x @ use == pytest.approx(counts) and (x >= 0).all()
    assert set((use @ lengths).tolist()) <= {0, 16}
    copies, left = packing.rounded(use, x, counts)
    assert (left >= 0).all() and (copies @ use + left == counts).all()
    assert left.sum() <= 0.1 * counts.sum()


def test_plan_is_a_partition():
    rng = np.random.default_rng(2)
    lengths = np.arange(1, 64)
    counts = rng.integers(0, 30, 63)
    lengths, counts = lengths[counts > 0], counts[counts > 0]
    plan = packing.Plan(lengths, counts, 64)
    size = np.repeat(lengths, counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    filled = defaultdict(list)
    for s, seq, off, place in zip(size.tolist(), *(a.tolist() for a in plan.place(size, rank))):
        assert (seq >= 0) != (place >= 0)
        for length, k, at in [(s, seq, off)] if seq >= 0 else [(n, k, at) for _, n, k, at in plan.cuts(place, s)]:
            filled[k].append((at, length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    assert sorted(filled) == list(range(plan.first_whole_run))
