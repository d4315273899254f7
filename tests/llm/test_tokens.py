"""Encoding, decoding and token files against the tokenizers library called plainly."""

import hashlib
import random
import zlib
from array import array

import pytest
from pyspark.sql import functions as F

from vitalframe.llm import bpe_tree, token_files
from vitalframe.llm.common import read_table
from vitalframe.llm.encoders import encoder, vocabulary

SF = "/root/testdata/sf0.001"
ODD = ["", "a  b \n\n c   ", "don't 'SS''s x'll  ", "<|endoftext|> hi", "é́x y", "ÀÉµ½² 12", "!!'re'x  'd\t\n", " ", "\x1c\x85 z",
       "漢字かな交じり文" * 30, "a" * 500, "ab" * 300, "'s" * 200, "<|endoftext|>" * 40, "é" * 200, "x<|startoftext|>y" * 30, "123 45\n" * 50]


def plain(file, texts):
    tok = encoder(vocabulary(file)).tok
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_pre_tokens(file, spark):
    texts = ODD + [r.text for r in read_table(spark, SF, "documents").select("text").collect()]
    e = encoder(vocabulary(file))
    assert [array("I", e.encode(t)).tolist() for t in texts] == plain(file, texts)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("leaf", [7, 40, 300])
def test_joined_parts_equal_the_whole(file, leaf):
    tok = encoder(vocabulary(file)).tok
    rnd = random.Random(leaf)
    texts = ODD + ["".join(rnd.choice(["the", "ing", "e", "s", "'", " ", "\n", "é", "1", "!", "<|endoftext|>", "aaaa", "́", "漢", "tion"]) for _ in range(400)) for _ in range(25)]
    texts += ["".join(rnd.choice("abcdeth") for _ in range(1500)) for _ in range(8)]
    for text in texts:
        parts = [bpe_tree.Part.of(tok, text[k : k + leaf]) for k in range(0, len(text), leaf)] or [bpe_tree.Part.of(tok, "")]
        assert bpe_tree.concatenate(tok, parts).ids == tok.encode(text, add_special_tokens=False).ids, text[:80]


def rows(spark, n=2):
    data = [(i, t, "x", 1.0) for i, t in enumerate(ODD)] + [(900, None, None, None), (901, "same", "a", 2.0), (901, "same", "a", 2.0), (None, "no id", "b", 0.0)]
    return spark.createDataFrame(data, "doc_id long, text string, ids string, n_tokens double").repartition(n)


def test_encode_and_digest(spark):
    df = rows(spark)
    got = sorted(map(tuple, bpe_tree.digest(bpe_tree.encode(df, F.col("doc_id"), F.col("text"), leaf=64)).collect()), key=str)
    tok = encoder(vocabulary("word_bpe_49k.json")).tok
    want = []
    for r in df.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_tree.digest(bpe_tree.encode(df.where("false"), F.col("doc_id"), F.col("text"))).count() == 0


def test_lists_come_from_the_step_that_encodes(spark):
    df = rows(spark)
    got = bpe_tree.encode(df, F.col("doc_id"), F.col("text"), leaf=64, lists=True)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids", "array<int>")]
    tok = encoder(vocabulary("word_bpe_49k.json")).tok
    want = [(r.doc_id, len(ids), ids) for r in df.collect() for ids in [tok.encode(r.text or "", add_special_tokens=False).ids]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_bpe_stage_has_one_python_step_a_task(spark):
    # short texts, pieces of long ones, joins of pieces: a second step after any of them keeps a second worker a core
    plan = bpe_tree.encoded(spark, rows(spark), SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("FlatMapGroupsInPandas") == 1


def test_op5_against_library(spark):
    got = {r.doc_id: r for r in bpe_tree.op5_bpe_tree(spark, SF).collect()}
    docs = read_table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d, ids in zip(docs, plain("word_bpe_49k.json", [d.text for d in docs])):
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def check_files(docs, got):
    at = 0
    assert len(docs) == len(got)
    for d, ids, g in zip(docs, plain("byte_bpe_50k.json", [d.text for d in docs]), got):
        ids = [*ids, 0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)


def test_op6_against_library(spark):
    docs = read_table(spark, SF, "documents").orderBy("doc_id").collect()
    check_files(docs, token_files.op6_token_files(spark, SF).orderBy("start").collect())


def test_files_with_odd_rows_and_pruned_reads(spark, tmp_path):
    df, path = rows(spark, 3), str(tmp_path / "t")
    token_files.write_tokens(df, F.col("doc_id"), F.col("text"), path)
    got = token_files.token_index(spark, path).orderBy("start").collect()
    order = df.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.asc_nulls_first("doc_id"), "tie").collect()
    check_files(order, got)
    one = token_files.read_tokens(spark, path).where("doc_id = 901")
    assert [r.n_tokens for r in one.collect()] == [2, 2]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,901)]" in one._jdf.queryExecution().toString()
    token_files.write_tokens(df.where("false"), F.col("doc_id"), F.col("text"), str(tmp_path / "e"))
    assert token_files.token_index(spark, str(tmp_path / "e")).count() == 0
