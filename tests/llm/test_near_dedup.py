"""Near-duplicate components against all pairs of plain shingle sets."""

import random

from pyspark.sql import functions as F

from vitalframe.llm import near_dedup as nd
from .test_embeddings import union_find
from .test_fingerprints import plain_set

SF = "/root/testdata/sf0.001"


def brute(rows):
    sets = {i: plain_set(t) for i, t in rows}
    ids, links = sorted(sets), []
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    comp = union_find(ids, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_op1_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(nd.op1_minhash_dedup(spark, SF)) == brute(rows)


def variants(rnd, base, n, rate):
    return [" ".join(rnd.choice("abcdefgh") * 5 if rnd.random() < rate else w for w in base) for _ in range(n)]


def test_groups_chains_and_odd_texts(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    texts = ["", None, " \n", "one", "ONE", "one two", "one two three four five", "One  two three FOUR five"]
    base = [word() for _ in range(120)]
    texts += variants(rnd, base, 60, 0.03) + variants(rnd, base, 60, 0.06)
    # a chain: each document drops the words the next one adds
    long = [word() for _ in range(400)]
    texts += [" ".join(long[k * 8 : k * 8 + 120]) for k in range(30)]
    shared = " ".join(word() for _ in range(60))
    texts += [" ".join(word() for _ in range(60)) + " " + shared for _ in range(20)] + [shared] * 9
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    nd.BLOCK, block = 16, nd.BLOCK
    try:
        assert got(nd.near_duplicates(df, F.col("doc_id"), F.col("text"))) == brute(rows)
    finally:
        nd.BLOCK = block


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert nd.near_duplicates(spark.createDataFrame([], schema), F.col("doc_id"), F.col("text")).count() == 0
    out = nd.near_duplicates(spark.createDataFrame([(7, "a b c")] * 3 + [(8, "a b c"), (9, None)], schema), F.col("doc_id"), F.col("text")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(7, 7), (7, 7), (7, 7), (8, 7), (9, 9)]


def test_stage_keeps_one_of_each_component(spark):
    data = [(3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (1, "A b c d e f", "y"), (4, "", "x"), (5, None, "x"), (6, "other words stand here too", None), (None, "a b c d e f", "z"), (4, "", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, _k string")
    got = sorted(map(tuple, nd.keep_one(spark, docs, SF).collect()), key=str)
    assert got == sorted([data[1], data[3], data[4], data[5], data[6], data[7]], key=str)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    want = {i for i, r in brute([(r.doc_id, r.text) for r in real.collect()]).items() if r[2]}
    out = nd.keep_one(spark, real, SF)
    assert out.columns == real.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_documents_of_shared_passages_make_few_block_pairs(spark, monkeypatch):
    """Three passages a document: lists are long, no hub collides often enough, and hardly anything links."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    passages = [" ".join(word() for _ in range(40)) for _ in range(14)]
    counted = {}

    def run(n):
        texts = [" ".join(rnd.sample(passages, 3)) for _ in range(n)]
        rows = list(enumerate(texts))
        kept = nd.keep

        def watch(df, name):
            out = kept(df, name)
            if name == "dedup-pairs":
                counted[n] = out.count()
            return out

        with monkeypatch.context() as m:
            m.setattr(nd, "keep", watch)
            assert got(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id"), F.col("text"))) == brute(rows)

    run(150)
    run(300)
    assert counted[300] < 3000 and counted[300] < 3.5 * counted[150]
