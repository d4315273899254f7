"""op11: against all pairs of words, on hand-made odd rows and on random words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vitalframe.llm import spelling


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            found[low] += 1
    return {w: n for w, n in found.items() if n >= 2 and len(w) >= 7}


def plain_groups(words, ratio=10):
    near = {w: set() for w in words}
    letters = sorted(set("".join(words)))
    for w in words:
        for i in range(len(w) + 1):
            for v in [w[:i] + c + w[i:] for c in letters] + [w[:i] + c + w[i + 1 :] for c in letters if i < len(w)] + [w[:i] + w[i + 1 :]]:
                if v != w and v in words:
                    near[w].add(v)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def got(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def random_rows(seed, n_docs=400):
    rng = random.Random(seed)
    parts = ["the", "in", "er", "an", "ou", "ré", "tion", "sch", "ß", "ça", "a"]
    base = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 5))) for _ in range(300)]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.03)), 299)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", w[k] * 2, "x", "Q"]) + w[k + 1 :]
            words.append(w.capitalize() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("leaf, fine", [(8192, 16), (40, 3)])
def test_against_all_pairs(spark, monkeypatch, leaf, fine):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "FINE", fine)
    rows = random_rows(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    counted = spelling.word_counts(docs, F.col("doc_id"), F.col("text"))
    words = plain_words(rows)
    assert {tuple(r) for r in counted.collect()} == set(words.items())
    want = plain_groups(words)
    assert got(spelling.variant_groups(counted)) == want
    assert sum(1 for r in want if r[1] is not None) > 20


def test_odd_rows(spark):
    long_run = "ab" * 1_500
    rows = [(1, None), (2, ""), (None, "Example example examplés"), (3, "example " * 30 + "exampel exampel exämple"), (3, "exämple examples examples"),
            (4, f"{long_run} {long_run}c"), (5, f"{long_run} {long_run}c {long_run}"), (6, "stunned stunned unnstd \U00010400abcdefg abcdefg"), (6, "stunned")] + [(7, "repeated row repeated")] * 3
    docs = spark.createDataFrame([(d, t, "x", "y", 0) for d, t in rows], "doc_id long, text string, word string, leaf string, n int")
    want = plain_groups(plain_words(rows))
    assert got(spelling.variant_groups(spelling.word_counts(docs, F.col("doc_id"), F.col("text")))) == want
    assert any(r[0].startswith("abab") for r in want)


def test_chain_of_forms_and_ties(spark):
    words = {"aaaaaaa": 1000, "aaaaaab": 100, "aaaaabb": 10, "aaaabbb": 1, "ccccccc": 7, "cccccca": 70, "ccccccb": 70, "abcdefg": 5, "bacdefg": 50}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = {r.word: r for r in spelling.variant_groups(df).collect()}
    assert rows["aaaabbb"].root == "aaaaaaa" and rows["aaaabbb"].form == "aaaaabb"
    assert rows["ccccccc"].form == "cccccca"
    assert rows["abcdefg"].form is None  # two letters changed places: two edits
    assert {tuple(r) for r in rows.values()} == plain_groups(words)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(spelling.word_counts(docs, F.col("doc_id"), F.col("text"))).count() == 0


def test_query_reads_the_whole_table(spark):
    from tests.conftest import SF001

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spelling.op11_spelling_variants(spark, SF001)) == plain_groups(plain_words(rows))
