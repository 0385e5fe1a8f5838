"""The prefix trie against plain dictionaries, and against SQL."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import prefix_trie
from tests.llm.test_native import as_dicts, with_sql

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "turn", "role", "text"]


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(z[2], z[4]) for z in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = None if c is None else int(c - np.fmod(c, 5))
        made[c] = tuple(own.get(base, [])[:h] + turns[h:] if c is not None else turns)
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    least = {p: min((c for c in m if c is not None), default=None) for p, m in nodes.items()}
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c in nodes[p] if c is not None and len(made[c]) == len(p))).encode()).hexdigest()
    return sorted(
        ({"conv_id": least[p], "depth": len(p), "parent_conv_id": least[p[:-1]] if p else None, "n_convs": len(nodes[p]), "n_children": len(kids[p]), "n_leaves": leaves[p], "saved_tokens": saved[p], "ends_sha256": sha(p)} for p in nodes),
        key=str,
    )


def odd_rows(seed, convs, words):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        n = rng.randrange(12)
        if rng.random() < 0.5:
            n, same = 9, random.Random(1)
            rows += [(c, t, "user", same.choice(words)) for t in range(n)]
        else:
            rows += [(c, rng.choice([None, 1, 2, t]), rng.choice(["user", "assistant", None, ""]), rng.choice(words)) for t in range(max(n, 1))]
    return rows + rows[:7]


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 4), (3, 13)])
def test_trie_is_brute_force(spark, seed, parts):
    convs = [*range(-8, 60), 10_000, 10_001, 9_999, None]
    rows = odd_rows(seed, convs, ["a", "b", "", None, "é😀", "long " * 3000])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("own"))
        assert as_dicts(prefix_trie.prefix_trie(prefix_trie.rebuilt(df))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_is_its_sql(spark):
    rows = odd_rows(5, range(30), ["a", "b", "c"])
    got = as_dicts(prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))))
    assert got == with_sql(prefix_trie.SQL, "conversations", rows, NAMES) == brute(rows)


def test_one_group_of_copies_over_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    rows = [(5 * c, 0, "user", "same") for c in range(-20, 100)] + [(5 * c, 1, "assistant", f"own {c % 3}") for c in range(-20, 100)]
    assert as_dicts(prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(none)).count() == 0


def test_forest_makes_one_node_for_many_children():
    paths = [bytes([k]) * 16 + bytes([j]) * 16 for k in range(2) for j in range(3)]
    tree = prefix_trie.Forest([2] * 6, np.array([prefix_trie.common(a, b) for a, b in zip(paths, paths[1:])], "i8"))
    branching = [sorted(c) for d, c in zip(tree.depth, tree.children, strict=True) if c]
    assert sorted(map(len, branching)) == [2, 3, 3] and tree.depth[tree.top] == 0
