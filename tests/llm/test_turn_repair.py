"""Repair of conversations against plain dynamic programming with whole strings, and against SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftline.llm import turn_repair
from tests.llm.test_native import as_dicts, with_sql

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "turn", "role", "text"]
BARE = "".join(map(chr, (32, 9, 10, 11, 12, 13)))


def brute(rows):
    """gaps, faults, cost, audit and repaired text of one conversation's rows (turn, role, text), by whole strings."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda z: (z[0], z[1], z[2], hashlib.md5(z[3].encode()).hexdigest()))
    seen, count = set(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    ways, before = {0: (0, "", ())}, None

    def better(found, state, way):
        if state not in found or way[:2] < found[state][:2]:
            found[state] = way

    def inserted(found):
        for _ in range(4):
            for s, (c, a, t) in list(found.items()):
                better(found, 3 if s == 2 else 2, (c + 5, a + "I", (*t, "assistant:" if s == 2 else "user:")))
        return found

    for _, _, role, text in rows:
        last = text.rstrip(BARE)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "ok"
        seen.add((role, text))
        if fault in count:
            count[fault] += 1
        first = role[:1]
        count["illegal"] += before is not None and before + first not in ("su", "ua", "au")
        before, now, late = first, {}, 5 * (fault == "truncated")
        for s, (c, a, t) in inserted(dict(ways)).items():
            better(now, s, (c + 2, a + "D", t))
            if fault not in ("blank", "duplicate"):
                z, name = (3, "assistant") if s == 2 else (2, "user")
                better(now, z, (c + 1 + late, a + "R", (*t, f"{name}:{text}")))
                if first == name[0]:
                    better(now, z, (c + late, a + "K", (*t, f"{role}:{text}")))
                if first == "s" and s == 0:
                    better(now, 1, (c + late, a + "K", (*t, f"{role}:{text}")))
        ways = now
    turns = [r[1] for r in rows if r[0]]
    cost, audit, text = min((w for s, w in inserted(dict(ways)).items() if s in (0, 3)), key=lambda w: w[:2])
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **count, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(text).encode()).hexdigest()}


def odd_rows(seed, n):
    rng = random.Random(seed)
    texts = ["ok.", "well", "yes!", "", None, " \t", "why? ", "ok.\x0b", "a ", "no. ", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "aide", "sys\nx"]
    rows = [(rng.choice([0, 1, 2, 3, 4, None, -9]), rng.choice([None, -3, 0, 1, 2, 5, 9, 40]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]
    return rows + rows[: n // 5]


@pytest.mark.parametrize(("seed", "n"), [(1, 30), (2, 120), (3, 300)])
def test_report_is_brute_force(spark, seed, n):
    rows = odd_rows(seed, n)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("edit", F.lit("own"))
    got = {r["conv_id"]: r.asDict() for r in turn_repair.repair_report(df.drop("edit"), df).collect()}
    want = {c: {"conv_id": c, **brute([r[1:] for r in rows if r[0] == c])} for c in {r[0] for r in rows}}
    assert got == want


def test_one_conversation_over_many_ranges(spark):
    """Rows of one conversation fall into several ranges; the pieces give what one search over all gives."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", "no", "yes!"]) + str(rng.randrange(6)) + rng.choice([".", ""])) for t in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        edits = turn_repair.repair_edits(df)
        assert edits.select("part").distinct().count() > 3
        (got,) = as_dicts(turn_repair.repair_report(df, df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {"conv_id": 7, **brute([r[1:] for r in rows])}


def test_damage_and_sql(spark):
    rng = random.Random(8)
    rows = [(c, t, r, f"{x} {rng.randrange(3)}.") for c in range(40) for t, (r, x) in enumerate([("system", "be"), ("user", "hm"), ("assistant", "so"), ("user", "a"), ("assistant", "b")][rng.randrange(2) :])]
    rows += [(50, None, None, None), (50, None, "user", "x."), (51, 3, "user", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_dicts(turn_repair.repair_report(turn_repair.damaged(df), df))
    assert got == with_sql(turn_repair.SQL, "conversations", [(c, t, r, x) for c, t, r, x in rows], NAMES)
    hits = {(c, t): zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, _, _ in rows if t is not None}
    kept = {(r["conv_id"], r["turn"]): r["count"] for r in turn_repair.damaged(df.where("turn is not null")).groupBy("conv_id", "turn").count().collect()}
    assert kept == {k: 2 if h == 3 else 1 for k, h in hits.items() if h}


def test_empty_table_and_conversations_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair_edits(none).count() == 0 and turn_repair.repaired_turns(none).count() == 0
    assert turn_repair.repair_report(none, none).count() == 0
    (got,) = as_dicts(turn_repair.repair_report(none, spark.createDataFrame([(3, 1, "user", "x.")], SCHEMA)))
    assert got == {"conv_id": 3, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_repaired_turns_are_whole_texts_in_a_legal_order(spark):
    rows = odd_rows(9, 80)
    out = turn_repair.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "part", "step").collect()
    texts = {r[3] for r in rows} | {""}
    by = {}
    for r in out:
        assert r["text"] in texts
        by.setdefault(r["conv_id"], []).append(r["role"][:1])
    for initials in by.values():
        rest = initials[1:] if initials[0] == "s" else initials
        assert rest and rest == ["u", "a"] * (len(rest) // 2)


def test_search_holds_only_what_is_open():
    search, most = turn_repair.Search(), 0
    told = 0
    for k in range(20_000):
        told += sum(1 for _ in search.push((k,), "ua"[k % 2], "ok"))
        nodes = set()
        for _, _, node in search.ways.values():
            while node is not None and id(node) not in nodes:
                nodes.add(id(node))
                node = node.parent
        most = max(most, len(nodes))
    told += sum(1 for _ in search.finish())
    assert told == 20_000 and most < 64
