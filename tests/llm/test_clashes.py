"""Stages carry columns of any names; adversarial and very long texts end in time."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vitalframe.llm import pii_surrogates, toxicity

SF = "/root/testdata/sf0.001"
CLASHES = ["_key", "key", "_names", "_n_entities", "n_entities", "_kinds", "kinds", "_sum", "total", "rows", "_copies", "times", "_copy", "nth", "_a", "_b", "a", "b", "_node", "node",
           "_lang_pred", "lang_pred", "lang_score", "lang_spans", "row_key", "parts", "aliases", "_atoms", "ids", "n_tokens", "component_id", "size", "pattern", "KEPT"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_carry_clashing_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    plain = sorted(tuple(r) for r in stage(spark, docs, SF).collect())
    more = docs.withColumns({c: F.concat(F.lit(f"mine {c} "), F.col("doc_id").cast("string")) for c in CLASHES})
    out = stage(spark, more, SF)
    if name == "bpe":
        assert sorted(tuple(r) for r in out.collect()) == plain
        return
    assert out.columns == more.columns
    rows = out.collect()
    assert sorted(tuple(r[c] for c in docs.columns) for r in rows) == plain
    assert all(r[c] == f"mine {c} {r.doc_id}" for r in rows for c in CLASHES)


MB = 1 << 20
LONG = {
    "dots after an at sign": "x@" + "a." * (MB // 2) + "1", "letters after an at sign": "x@" + "a" * MB, "hyphens": "x@" + "-." * (MB // 2), "at signs": "@" * MB, "a local part": "a" * MB + "@",
    "digits": "1" * MB, "digits and spaces": "1 " * (MB // 2), "digits and dots": "1." * (MB // 2), "octets": "255." * (MB // 4), "plus signs": "+1" * (MB // 2), "brackets": "(123) " * (MB // 6),
    "capitals": "AB12" * (MB // 4), "capitals and spaces": "AB12 " * (MB // 5), "names": "Mr A" + "'" * MB, "many names": "Mr Xa " * (MB // 6), "a name": "Frau A" + "b" * MB,
    "an open secret": "token='" + "x" * MB, "secrets": "sk-" * (MB // 3), "more secrets": "ghp_" + "a" * MB + "_", "labels": "password=" * (MB // 9), "quotes": "token='" * (MB // 7), "hyphened digits": "123-45-" * (MB // 7),
}


def test_patterns_do_not_overflow(spark):
    """Every alternative is tried on texts of a megabyte: a repeated group would end the executor, a quadratic search this test."""
    df = spark.createDataFrame(list(enumerate(LONG.values())), "doc_id long, text string").repartition(8)
    began = time.time()
    found = df.select("doc_id", pii_surrogates.has_entity(F.col("text")).alias("has"), F.size(F.regexp_extract_all("text", pii_surrogates.pattern_for(F.col("text")), F.lit(0))).alias("n")).collect()
    assert len(found) == len(LONG) and time.time() - began < 120
    some = [("x@" + "a." * 5000 + "de", "write x@mail.de"), ("x" * MB + " y@mail.de ", "end"), ("Mr Xavier " + "word " * 100_000, "Xavier")]
    out = {r.doc_id: r.text for r in pii_surrogates.replace_entities(spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate(some)], "doc_id long, text string"), "text", "k").collect()}
    assert "mail.de" not in out[0] and "y@mail" not in out[1] and "Xavier" not in out[2] and len(out) == 3


def test_country_codes_stay(spark):
    texts = ["+45 12 34 56 78 or +4512345678", "+49 30 1234567", "+33 1 23 45 67 89", "+7 912 345-67-89", "+1 (555) 123-4567 is 555-123-4567", "+352 27 12 34 56"]
    out = {r.doc_id: r.text for r in pii_surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", "k").collect()}
    for i, code in enumerate(("+45 ", "+49 ", "+33 ", "+7 ", "+1 (", "+352 ")):
        assert out[i].startswith(code) and out[i] != texts[i], (texts[i], out[i])
        shape = lambda t: "".join("0" if c.isdigit() else c for c in t)
        assert shape(out[i]) == shape(texts[i])
    a, b = out[0].split(" or ")
    assert a.replace(" ", "") == b
    digits = "".join(c for c in out[4] if c.isdigit())
    assert digits[1:11] == digits[11:]


def test_made_up_names_are_not_real_ones(spark):
    real = [("SURNAME", f"{a}{b}{c}a") for a in ("ba", "bel", "cor") for b in ("da", "fa") for c in ("ka", "lor")] + [("GIVEN_F", f"n{i}") for i in range(2000)]
    table = pii_surrogates.assign(spark.createDataFrame(real, "kind string, norm string"), "k").collect()
    assert not {r.surrogate for r in table if r.kind == "GIVEN_F"} & {n for k, n in real if k == "SURNAME"}


def test_decoding_is_linear():
    model = toxicity.CharModel(np.random.default_rng(1).integers(0, 50, toxicity.SYMBOLS**3))
    times = []
    for n in (4_000, 32_000):
        began = time.time()
        text = model.best("a" * n + "1d!0t")[1]
        times.append(time.time() - began)
        assert 0 < len(text) <= n + 5
    assert times[1] < 20 * times[0]
