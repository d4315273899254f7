"""Sharding, mixing, language, toxicity and surrogates: brute force, properties and odd rows."""

import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalframe.llm import kd_sharding, language_id, mixing, pii_surrogates, toxicity
from vitalframe.llm.common import maybe_in, read_table, word_count

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, shard int, size string"
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "fr", ""), (4, "12 34 !!", "en", "a"), (4, "12 34 !!", "en", "a"), (None, "no id here", "en", None),
       (5, "漢字かな", "en", "é"), (6, "x" * 5000, "fr", "b"), (7, "\x85 a\x1fb c", None, "z")]


def table(spark, tmp_path, rows, name="t"):
    path = f"{tmp_path}/{name}"
    spark.createDataFrame([(*r, 9, "clash") for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return path


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_count_and_filter(spark):
    texts = [None, "", " ", "a", " a", "a ", " a  b\n", "\x85", "a\x1fb"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", word_count(F.col("text")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [len(words(t)) for t in texts]
    ids = spark.range(0, 3000, 3).select(F.col("id").alias("x"))
    hit = maybe_in(ids)
    assert spark.range(0, 3000).where((F.col("id") % 3 == 0) & ~hit(F.col("id"))).count() == 0
    assert spark.range(10**6, 10**6 + 10000).where(hit(F.col("id"))).count() < 20


# sharding

def check_shards(rows, out, near):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots, shards, load = defaultdict(list), defaultdict(set), Counter()
    for r in out:
        assert 0 <= r.shard < 8 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        shards[r.text_crc32].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    if near:
        assert max(load.values()) - min(load[k] for k in range(8)) <= near


def test_op10_shards(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    biggest = max(len(t.encode()) for _, t in rows)
    check_shards(rows, kd_sharding.op10_kd_sharding(spark, SF).collect(), 2 * biggest)


def test_shards_of_odd_and_hot_tables(spark, tmp_path):
    check_shards(ODD, kd_sharding.op10_kd_sharding(spark, table(spark, tmp_path, ODD)).collect(), 0)
    hot = [(i, "copy " * 50, "en", "a") for i in range(100)] + [(i, f"text {i} " * 20, "en", "b") for i in range(100, 300)]
    out = kd_sharding.op10_kd_sharding(spark, table(spark, tmp_path, hot, "hot")).collect()
    check_shards(hot, out, 0)
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    rest = sorted(load.values())[:-1]
    assert len(load) == 8 and max(rest) < 1.3 * min(rest)
    assert kd_sharding.op10_kd_sharding(spark, table(spark, tmp_path, [], "none")).count() == 0


# mixing

def plain_targets(sizes, total, most):
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(ranked)}
    lo, hi = 0.0, 1e9
    for _ in range(200):  # the water level by bisection
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(weight[s] * mid, most * sizes[s]) for s in sizes) < total else (lo, mid)
    return {s: min(weight[s] * hi, most * sizes[s]) for s in sizes}


def check_mix(rows, out, slack):
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len(words(t))
    want = plain_targets(sizes, 1.5 * sum(sizes.values()), 2)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len(words(t))) for i, t, *_ in rows)
    source = {i: s for i, _, _, s in rows}
    took, largest = Counter(), Counter()
    for r in out:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-3 * (1 + want[s])
        took[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(took[s] - want[s]) <= slack * largest[s] + 1


def test_op4_mix(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").select("doc_id", "text", "lang", "source").collect()]
    first = mixing.op4_mixing(spark, SF).collect()
    check_mix(rows, first, 0.5)
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.op4_mixing(spark, SF).collect()))


def test_mix_of_odd_tables(spark, tmp_path):
    check_mix(ODD, mixing.op4_mixing(spark, table(spark, tmp_path, ODD)).collect(), 1)
    assert mixing.op4_mixing(spark, table(spark, tmp_path, [], "none")).count() == 0


def best_flow(patterns, quotas):
    """Largest routed total and its least second-pass share by trying all integer flows."""
    arcs = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    for f in product(*[range(min(2 * patterns[p], quotas[s]) + 1) for p, s in arcs]):
        drawn, got = Counter(), Counter()
        for (p, s), x in zip(arcs, f):
            drawn[p] += x
            got[s] += x
        if all(drawn[p] <= 2 * patterns[p] for p in patterns) and all(got[s] <= quotas[s] for s in quotas):
            best = max(best, (sum(f), -sum(max(0, drawn[p] - patterns[p]) for p in patterns)))
    return best


@pytest.mark.parametrize("patterns, quotas", [
    ({("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 4, "b": 4}),
    ({("a", "b"): 3, ("b", "c"): 1}, {"a": 2, "b": 2, "c": 3}),
    ({("a", "b", "c"): 2, ("a",): 1}, {"a": 1, "b": 2, "c": 2}),
    ({("a",): 1, ("b",): 3}, {"a": 4, "b": 1}),
])
def test_flow_is_maximal_at_least_cost(patterns, quotas):
    flow, passes = mixing.route(patterns, quotas)
    assert (sum(flow.values()), -sum(passes[1].values())) == best_flow(patterns, quotas)
    for p in patterns:
        assert sum(flow[p, s] for s in p) == passes[0][p] + passes[1][p] and passes[0][p] <= patterns[p] >= passes[1][p]


def test_many_single_sources_are_routed_directly():
    patterns = {(f"s{i}",): 100 + i % 7 for i in range(20_000)} | {("s0", "s1"): 500}
    quotas = {f"s{i}": 150 for i in range(20_000)}
    began = time.time()
    flow, passes = mixing.route(patterns, quotas)
    assert time.time() - began < 20 and sum(flow.values()) == 150 * 20_000
    assert all(0 <= passes[k][p] <= n for k in (0, 1) for p, n in patterns.items())


def test_overlapping_sources(spark):
    rows = [(i, 10, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", "c", None]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    out, sizes, target = mixing.mix(df, F.col("doc_id"), F.col("size"), F.col("sources"), lambda s: dict.fromkeys(s, 300.0))
    assert sizes == {"a": 600, "b": 600, "c": 300, None: 300} and sum(r["size"] * r["copies"] for r in out.collect()) == 1200


# language

def brute_labels(s, switch):
    best = max(product(range(s.shape[1]), repeat=len(s)), key=lambda p: sum(s[i, j] for i, j in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])))
    return sum(s[i, j] for i, j in enumerate(best)) - switch * sum(a != b for a, b in zip(best, best[1:]))


def test_viterbi_labels_are_best():
    m = object.__new__(language_id.Model)
    rnd = np.random.default_rng(2)
    for _ in range(60):
        s = np.maximum(np.round(rnd.normal(-4, 5, size=(7, 3)), 3), -20.0) * rnd.choice([1, 3])
        got = m.label(s)
        value = s[np.arange(7), got].sum() - language_id.SWITCH * (np.diff(got) != 0).sum()
        assert value == pytest.approx(brute_labels(s, language_id.SWITCH))


def test_op3_language(spark):
    docs = {r.doc_id: r for r in read_table(spark, SF, "documents").collect()}
    out = language_id.op3_language_id(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_languages_of_mixed_scripts_and_odd_rows(spark, tmp_path):
    rows = [(10 + i, t, lang, "s") for i, (t, lang) in enumerate([("the cat sat on the mat and the dog ran", "en"), ("der hund und die katze sind nicht im haus", "de"), ("кошка и собака в доме на столе", "ru")] * 12)]
    path = table(spark, tmp_path, rows + ODD)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.op3_language_id(spark, path).collect()}
    assert all(got[r[0]][0] == r[2] for r in rows)
    assert got[1] == got[2] == got[3] == got[4] == ("und", 0.0) and got[5][0] != "und"
    docs = read_table(spark, path, "documents")
    m = language_id.fit(docs.where("doc_id >= 10"), F.col("text"), F.col("lang"))
    mixed = "the cat and the dog ran to the man " * 3 + "собака в доме на столе " * 3
    lang, _, spans = m.spans(mixed)
    assert lang == "en" and [s["lang"] for s in spans] == ["en", "ru"] and mixed[spans[1]["first"]] == "с"
    kept = language_id.keep_identified(spark, docs, path)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & {1, 2, 3, 4} == set()
    none = table(spark, tmp_path, [(1, "some words", None, "a")], "none")
    assert [r.lang_pred for r in language_id.op3_language_id(spark, none).collect()] == ["und"]
    assert language_id.op3_language_id(spark, table(spark, tmp_path, [], "empty")).count() == 0


# toxicity

def brute_decode(m, noisy):
    """All paths of the lattice."""
    best = None

    def walk(i, a, b, cost, out):
        nonlocal best
        if i == len(noisy):
            total = cost + (float(m.cost[a, b, 0]) if b else 0.0)
            best = min(best, total) if best is not None else total
            return
        ch, run = noisy[i], 1
        while i - run >= 0 and noisy[i - run] == ch:
            run += 1
        long_run = run > 2 or run == 2 and noisy[i + 1 : i + 2] == ch
        if ch.isalpha():
            c = toxicity.symbol(ch)
            walk(i + 1, b, c, cost + float(m.cost[a, b, c]), out + ch)
            if run > 1:
                walk(i + 1, a, b, cost + (toxicity.COST_DROP_RUN if long_run else toxicity.COST_DROP_DOUBLE), out)
            return
        for x in toxicity.LEET.get(ch, ""):
            c = toxicity.symbol(x)
            walk(i + 1, b, c, cost + toxicity.COST_LEET + float(m.cost[a, b, c]), out + x)
        drop, end = (toxicity.COST_DROP_DIGIT,) * 2 if ch.isdigit() else (toxicity.COST_DROP_MARK, toxicity.COST_END)
        walk(i + 1, a, b, cost + drop, out)
        walk(i + 1, 0, 0, cost + end + (float(m.cost[a, b, 0]) if b else 0.0), out + " ")

    walk(0, 0, 0, 0.0, "")
    return best


def test_decoding_is_the_best_path(spark):
    docs = spark.createDataFrame([("the idiot and the loser were stupid morons on the trash heap " * 5,), (None,)], "text string")
    m = toxicity.learn_characters(docs, F.col("text"))
    for noisy in ["1d10t", "l0s3r!", "stuuupid", "m.o.r.o.n", "t r a s h", "$tup1d", "iiddiioott"]:
        assert m.best(noisy)[0] == pytest.approx(brute_decode(m, noisy), abs=1e-4)
    r = toxicity.Restorer(m)
    assert [w for ws in r.words("an 1d10t, l0s3r $tup1d m.o.r.o.n t r a s h stuuupid ok!") for w in ws] == ["an", "idiot", "loser", "stupid", "moron", "trash", "stupid", "ok"]


def test_disguises_reach_the_decoder(spark):
    docs = spark.createDataFrame([("the idiot was an ass and the loser were stupid morons on the trash heap of all good letters " * 5,)], "text string")
    r = toxicity.Restorer(toxicity.learn_characters(docs, F.col("text")))
    restored = lambda t: [w for ws in r.words(t) for w in ws]
    for noisy in ["you i d i o t. next", "you i d i o t, next", 'you "i d i o t!" next', "you idiiot next", "you iidioot, next", "you 1d10t! next"]:
        assert restored(noisy) == ["you", "idiot", "next"]
    assert restored("an a s s") == restored("an @$$") == restored("an @$$!") == restored("an (a s s).") == ["an", "ass"]
    assert restored("all good letters, !!! $$$ -- 100 $1.50") == ["all", "good", "letters"]
    assert restored("-" * 200 + "ab") == ["ab"]


def test_op2_toxicity_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in read_table(spark, sf, "labels").collect()}
    out = toxicity.op2_toxicity(spark, sf).collect()
    assert len(out) == read_table(spark, sf, "documents").count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    pos, neg = ([r.score for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert np.mean([p > n for p in pos for n in neg]) > 0.9


def test_toxicity_of_odd_rows(spark, tmp_path):
    path = table(spark, tmp_path, ODD)
    out = toxicity.op2_toxicity(spark, path).collect()
    assert len(out) == len(ODD) and {r.score for r in out} == {0.0}
    docs = [(100 + i, ("you idiot " if i % 2 else "dear friend ") + f"w{i}", "en", "a") for i in range(60)]
    path = table(spark, tmp_path, ODD + docs, "some")
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(40)] + [(1, 0, 0), (100, 1, None)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    got = {r.doc_id: r.score for r in toxicity.op2_toxicity(spark, path).collect()}
    assert all((got[100 + i] > 0.5) == bool(i % 2) for i in range(60)) and got[1] == got[2] < 0.5


# surrogates

def test_surrogates_keep_format_and_people(spark):
    texts = {
        1: "Write to jo.doe7@mail3.example.com or JO.DOE7@MAIL3.EXAMPLE.COM from 10.20.30.40, call +1 (974) 555-3436 or 974-555-3436.",
        2: 'Card 4111 1111 1111 1111 and 4111111111111111, bad 2390409500648960; ssn 123-45-6789; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end.',
        3: "Mr. John Smith met Mrs Smith. John was late, said SMITH; Smithers stayed. Г-жа is not a name, Госпожа Анна Иванова is. IBAN DE89 3704 0044 0532 0130 00.",
        4: "Plain words, 12.5 kg, 2024-01-02, v1.2.3, a@b, 555-3436.", 5: None, 6: "", 7: "Frau Anna Müller und Herr Müller",
    }
    df = spark.createDataFrame([(i, t, "k") for i, t in texts.items()] * 2, "doc_id long, text string, _key string")
    out = pii_surrogates.replace_entities(df, "text", "key").collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 14 and {(r.doc_id, r.text) for r in out} == {(i, r.text) for i, r in got.items()}
    assert all(got[i].text == texts[i] and got[i]["_n_entities"] == 0 for i in (4, 5, 6))
    one = re.fullmatch(r"Write to ([a-z]{2}\.[a-z]{3}\d@([a-z]{4}\d\.[a-z]{7})\.com) or (\S+) from (\d+\.\d+\.\d+\.\d+), call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})\.", got[1].text)
    assert one and one[1] == one[3] and one.group(5, 6, 7) == one.group(8, 9, 10) and one[1] != "jo.doe7@mail3.example.com"
    two = re.fullmatch(r'Card (4\d{3} \d{4} \d{4} \d{4}) and (4\d{15}), bad (2\d{15}); ssn (\d{3}-\d{2}-\d{4}); token = "([0-9a-f]{40})" end\.', got[2].text)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    assert two and two[1].replace(" ", "") == two[2] and luhn(two[2]) and not luhn("2390409500648960")
    three = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+)\. (\w+) was late, said (\w+); Smithers stayed\. Г-жа is not a name, Госпожа ([а-яА-Я]+) ([а-яА-Я]+) is\. IBAN (DE\d\d( \d{4}){4} \d\d)\.", got[3].text)
    assert three and three[2] == three[3] and three[1] == three[4] and three[1][-1] in "osnt" and "John" not in got[3].text and "Smith " not in got[3].text
    four = re.fullmatch(r"Frau (\w+) (\w+) und Herr (\w+)", got[7].text)
    assert four and four[2] == four[3] and re.search("(a|ine|ette)$", four[1])
    assert got[3]["_kinds"] == ["IBAN", "NAME"] and got[2]["_kinds"] == ["CARD", "SECRET", "SSN"]
    other = {r.doc_id: r.text for r in pii_surrogates.replace_entities(df, "text", "another key").collect()}
    assert other[1] != got[1].text and other[4] == texts[4]


def test_collisions_are_resolved(spark):
    # an IPv4 surrogate of 3 bits: force collisions by many entities in a tiny space of one-letter locals
    names = [(f"GIVEN_{g}", f"name{i}") for i in range(4000) for g in "MFX"]
    table_ = pii_surrogates.assign(spark.createDataFrame(names, "kind string, norm string"), "k").collect()
    spaces = defaultdict(set)
    for r in table_:
        spaces[r.kind[:5]].add(r.surrogate)
    assert len(table_) == 12000 and len(spaces["GIVEN"]) == 12000
    few = [("EMAIL", f"{a}{b}@x.de") for a in "abcdefghij" for b in "abcdefghijklm"]
    table_ = pii_surrogates.assign(spark.createDataFrame(few, "kind string, norm string"), "k").collect()
    assert len({r.surrogate for r in table_}) == len(few) and not {r.surrogate for r in table_} & {n for _, n in few}


def test_surrogates_do_not_run_out(spark):
    # more surnames than three syllables and an ending can make (93,750)
    many = spark.range(100_000).select(F.lit("SURNAME").alias("kind"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("norm"))
    out = pii_surrogates.assign(many, "k")
    assert out.agg(F.count("*"), F.countDistinct("norm"), F.countDistinct("surrogate")).first()[:] == (100_000,) * 3


def test_short_formats_grow(spark):
    # ten values, all of them entities; a masked secret; a secret of a script without a table
    texts = ['password="-----%d"' % i for i in range(2)] + ['password="********"', 'password="密码密码密码"', "用户@例子.com"]
    hexes = [("SECRET", f"-----{c}") for c in "0123456789"]
    table_ = pii_surrogates.assign(spark.createDataFrame(hexes, "kind string, norm string"), "k").collect()
    assert len({r.surrogate for r in table_}) == 10 and not {r.surrogate for r in table_} & {n for _, n in hexes}
    out = {r.doc_id: r.text for r in pii_surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", "k").collect()}
    assert len(set(out.values())) == len(texts) and not set(out.values()) & set(texts)
    assert re.fullmatch('password="[a-z]{8}"', out[2]) and re.fullmatch('password="[a-z]{6}"', out[3]) and re.fullmatch(r"[a-z]{2}@[a-z]{2}\.com", out[4])
    # digits a phone number has grown by follow the mention
    row = spark.createDataFrame([("PHONE", "12345", "+1 23 45", "987654")], "kind string, norm string, piece string, s string")
    assert row.select(pii_surrogates._rendered(*map(F.col, row.columns))).first()[0] == "+9 87 654"


def test_op8_removes_all_detected_entities(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    found = re.compile(r"[^\W_][\w.+-]*@[\w.-]+\.[A-Za-z]{2,}|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b|\b[0-9a-f]{40}\b")
    gone = {m for t in docs.values() for m in found.findall(t)}
    out = pii_surrogates.op8_pii_surrogates(spark, sf).collect()
    assert len(out) == len(docs) and len(gone) > 50
    for r in out:
        assert not set(found.findall(r.text)) & gone and len(found.findall(r.text)) == len(found.findall(docs[r.doc_id]))
        assert found.split(r.text) == found.split(docs[r.doc_id]) and (r.n_entities > 0) == (r.text != docs[r.doc_id])


def test_surrogates_of_an_empty_table(spark, tmp_path):
    assert pii_surrogates.op8_pii_surrogates(spark, table(spark, tmp_path, [])).count() == 0
    assert len(pii_surrogates.op8_pii_surrogates(spark, table(spark, tmp_path, ODD, "odd")).collect()) == len(ODD)
