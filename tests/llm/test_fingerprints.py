"""Shingles, fingerprints and next documents against plain Python."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from vitalframe.llm import fingerprints as fp
from vitalframe.llm.common import read_table
from vitalframe.llm.shingles import shingle_set, word_hashes

SF = "/root/testdata/sf0.001"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_shingle_sets_have_the_sizes_and_overlaps_of_plain_ones():
    rnd = random.Random(5)
    texts = ["", None, " \t\n", "One", "one", "a b c d", "a b c d e", "A  b\x0bc d\x1fe f", "é É \x85 x y z", "a b a b a b a b a b"]
    texts += [" ".join(rnd.choice(["a", "b", "cc", "dd", "É"]) for _ in range(rnd.randint(1, 40))) for _ in range(80)]
    for a in texts:
        assert len(shingle_set(a)) == len(plain_set(a))
        for b in texts:
            assert len(np.intersect1d(shingle_set(a), shingle_set(b))) == len(plain_set(a) & plain_set(b))
    assert len(set(word_hashes("ab ba a b").tolist())) == 4


def test_estimates_are_near_the_truth():
    rnd = random.Random(7)
    base = [str(rnd.randrange(10**6)) for _ in range(600)]
    for share in (0.0, 0.1, 0.3, 0.6, 0.9, 1.0):
        errors = []
        for _ in range(12):
            cut = int(600 * share)
            other = base[:cut] + [str(rnd.randrange(10**6)) for _ in range(600 - cut)]
            a, b = " ".join(base), " ".join(other)
            errors.append(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - jaccard(a, b))
        assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.1


def test_short_and_empty_texts():
    assert fp.fingerprint("") is None and fp.packed(None) == "" and fp.likeness(None, None) == 1.0
    one, two = fp.fingerprint("only these"), fp.fingerprint("a b c d e f")
    assert fp.likeness(one, one) == 1.0 and fp.likeness(one, None) == 0.0 and len(fp.packed(two)) == fp.BINS * fp.BITS // 4
    low = fp.bin_minima(np.array([1 << 60, 5], np.uint64))
    assert set(low.tolist()) == {1 << 60, 5}


def brute(rows):
    """rows in document order."""
    out = {}
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1] or ""
        t = t or ""
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        a, b, c = fp.fingerprint(t), fp.fingerprint(e), fp.fingerprint(n)
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fp.packed(a), fp.packed(b), fp.likeness(a, b), fp.likeness(a, c))
    return out


def test_op7_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").orderBy("doc_id").collect()]
    assert {r[0]: tuple(r)[1:] for r in fp.op7_fingerprints(spark, SF).collect()} == brute(rows)


def test_odd_tables(spark, tmp_path):
    def run(data):
        path = str(tmp_path / str(len(data)))
        spark.createDataFrame(data, "doc_id long, text string, bucket string, halo int").repartition(3).write.parquet(f"{path}/documents.parquet")
        return fp.op7_fingerprints(spark, path).collect()

    assert run([]) == []
    assert {r[0]: tuple(r)[1:] for r in run([(5, "a b c d e f g h", "x", 1)])} == brute([(5, "a b c d e f g h")])
    data = [(i, ["", None, "x" * i, "w1 w2 w3 w4 w5 w6 " * i][i % 4], "b", 2) for i in range(40)]
    assert {r[0]: tuple(r)[1:] for r in run(data)} == brute([(d, t) for d, t, _, _ in data])
    assert len(run([(1, "same text", "x", 1)] * 5 + [(None, "no id", "y", 1), (2, "z", "y", 1)])) == 7
    assert fp.fingerprints(spark.createDataFrame([(1, None)], "doc_id long, text string"), F.col("doc_id"), F.col("text")).collect()[0].fingerprint == ""
