"""op12: against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vitalframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def tid(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def plain_nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, tid(role, text), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(set)
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        p = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(p, [])[:h] + ts[h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].add(c)
    kids, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, ms in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(ms) - 1) * words
            leaves[path[:d]] += not kids[path]
    out = []
    for path, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(built[c]) == len(path))
        out.append((min(ms), len(path), min(members[path[:-1]]) if path else None, len(ms), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        df = df.withColumns({"conv": F.lit("x"), "pos": F.lit("y"), "q": F.lit(1), "words": F.lit("z"), "node": F.lit(2)})
    table = prefix_trie.turns(df, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    nodes = prefix_trie.prefix_nodes(*prefix_trie.rebuilt(table))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert nodes.columns[:8] == cols or set(nodes.columns) == set(cols)
    return sorted((tuple(r) for r in nodes.select(*cols).collect()), key=str)


def random_rows(seed, n=150, most=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 400), n):
        first = rng.choice("abc")
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]), first * 2 if t < 3 else rng.choice(["a b", "c", "d\te  f", ""])))
    return rows


@pytest.mark.parametrize("container, step, chunk", [(4096, 1024, 4096), (20, 1024, 4), (3, 2, 2)])
def test_against_plain_prefixes(spark, monkeypatch, container, step, chunk):
    for name, v in (("CONTAINER", container), ("STEP", step), ("CHUNK", chunk)):
        monkeypatch.setattr(prefix_trie, name, v)
    rows = random_rows(3)
    assert got(spark, rows) == plain_nodes(rows)


def test_long_conversations_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CONTAINER", 30)
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(c, t, "user", f"w {t} " * (t % 4)) for c in range(100, 116) for t in range(90)]  # copies
    rows += [(c, t, "user", f"w {t} " * (t % 4) if t < c - 150 else "other") for c in (200, 230, 231) for t in range(100)]
    rows += [(c, t, "a", "same") for c in range(300, 420, 20) for t in range((c - 280) // 10)]  # prefixes of each other
    assert got(spark, rows) == plain_nodes(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, None, "user", "x"), (2, 5, "user", "long " * 50_000), (2, 5, "user", "long " * 50_000), (None, 1, "user", "lost"),
            (20, 0, "user", ""), (20, 0, "user", ""), (21, 1, "", "a"), (40, 3, "user", "é ü"), (45, 0, "u", "serhi"), (46, 0, "us", "erhi"), (-3, 0, "user", "x"), (0, 9, "user", "q")]
    assert got(spark, rows, extra=True) == plain_nodes(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_query_reads_the_whole_table(spark):
    from tests.conftest import SF001

    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = prefix_trie.op12_prefix_trie(spark, SF001).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_nodes(rows)
