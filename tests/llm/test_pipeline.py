"""The corpus pipeline: every stage against a plain version of its decision."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from vitalframe.llm.common import keep
from vitalframe.llm.encoders import encoder, vocabulary

from .test_near_dedup import brute
from .test_rows import check_mix, words

SF = "/root/testdata/sf0.001"
FOUND = re.compile(r"[^\W_][\w.+-]*@[\w.-]+\.[A-Za-z]{2,}|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b|\b[0-9a-f]{40}\b")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), f"test-{name}")
        assert name == "bpe" or docs.columns == columns
        out.append(docs.collect())
    return out


def test_language_stage_keeps_all_texts_with_a_language(stages):
    assert {r.doc_id for r in stages[1]} >= {r.doc_id for r in stages[0] if r.text and re.search(r"[^\W\d_]{4}", r.text)}
    assert all(r in stages[0] for r in stages[1])


def test_dedup_stage_keeps_one_of_each_group(stages):
    kept = {i for i, (_, _, first) in brute([(r.doc_id, r.text) for r in stages[1]]).items() if first}
    assert Counter(r.doc_id for r in stages[2]) == Counter(kept)


def test_pii_stage_changes_nothing_but_entities(stages):
    before = {r.doc_id: r for r in stages[2]}
    gone = {m for r in stages[2] for m in FOUND.findall(r.text)}
    assert len(stages[3]) == len(stages[2]) and gone
    for r in stages[3]:
        assert FOUND.split(r.text) == FOUND.split(before[r.doc_id].text) and not set(FOUND.findall(r.text)) & gone
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source) and r.n_chars == len(r.text)


def test_mix_stage_repeats_documents_towards_the_targets(stages):
    rows = {r.doc_id: r for r in stages[3]}
    copies = Counter(r.doc_id for r in stages[4])
    assert max(copies.values()) <= 2 and all(r == rows[r.doc_id] for r in stages[4])
    from collections import namedtuple

    sizes = Counter()
    for r in rows.values():
        sizes[r.source] += len(words(r.text))
    from .test_rows import plain_targets

    target = plain_targets(sizes, 1.5 * sum(sizes.values()), 2)
    row = namedtuple("row", "doc_id size source_size target taken")
    got = [row(i, len(words(r.text)), sizes[r.source], target[r.source], copies[i] * len(words(r.text))) for i, r in rows.items()]
    check_mix([(r.doc_id, r.text, r.lang, r.source) for r in rows.values()], got, 0.5)


def test_bpe_stage_encodes_every_row(stages):
    tok = encoder(vocabulary("word_bpe_49k.json")).tok
    want = Counter((r.doc_id, tuple(tok.encode(r.text, add_special_tokens=False).ids)) for r in stages[4])
    assert Counter((r.doc_id, tuple(r.ids)) for r in stages[5]) == want and all(r.n_tokens == len(r.ids) for r in stages[5])


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
