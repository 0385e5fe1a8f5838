"""The source mix against SQL and by its own rules."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import mixing
from tests.llm.test_native import as_dicts, with_sql

SCHEMA = "doc_id long, text string, source string"
NAMES = ["doc_id", "text", "source"]
OUT = ["doc_id", "size", "source_size", "target", "taken"]


def odd_docs(seed, n=400):
    rng = random.Random(seed)
    sources = ["a"] * 9 + ["b", "B", "é", "", None, "z", "empty"]
    rows = []
    for k in range(n):
        s = rng.choice(sources)
        words = 0 if s == "empty" else rng.choice([0, 1, 3, 10, 40, 300])
        rows.append((rng.choice([k, None, 7]), None if words == 0 and rng.random() < 0.5 else " \x0b".join(f"w{rng.randrange(9)}" for _ in range(words)), s))
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_is_its_sql(spark, seed):
    rows = odd_docs(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"taken": F.lit("own"), "copies": F.lit(1), "extra": F.lit(2)})
    out = mixing.mix(df)
    assert set(out.columns) == {"doc_id", "source", "extra", "size", "source_size", "target", "copies", "taken"}
    assert as_dicts(out.select(*OUT)) == with_sql(mixing.SQL, "documents", rows, NAMES)


def test_mix_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    rows = odd_docs(4)
    assert as_dicts(mixing.mix(spark.createDataFrame(rows, SCHEMA)).select(*OUT)) == with_sql(mixing.SQL, "documents", rows, NAMES)


def test_targets_are_met_and_nested(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randrange(1, 50), f"s{min(k % 29, 6)}") for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    before = None
    for share in (0.3, 0.9, 1.5):
        out = mixing.mix(df, share=share).collect()
        for s in {r["source"] for r in out}:
            mine = [r for r in out if r["source"] == s]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 25
            assert mine[0]["target"] <= 2 * mine[0]["source_size"] and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
        assert abs(sum({r["source"]: r["target"] for r in out}.values()) - share * sum(r["size"] for r in out)) < 1e-6 * len(out)
        now = {r["doc_id"]: r["copies"] for r in out}
        assert before is None or all(now[k] >= c for k, c in before.items())
        before = now
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(3)).collect()}
    assert again == before


def test_equal_rows_are_taken_by_number(spark):
    """A third of all rows are one document; as many of them are taken as the budget asks for."""
    rows = [(1, "a b c", "x")] * 500 + [(k, "a b c d", "y") for k in range(1000)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(6))
    for s in ("x", "y"):
        mine = out.where(F.col("source") == s).agg(F.sum("taken").alias("t"), F.max("target").alias("g")).first()
        assert abs(mine["t"] - mine["g"]) <= 2
    many = mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA))
    assert many.columns == ["doc_id", "text", "source"] and many.count() == out.agg(F.sum("copies")).first()[0]


def test_empty_tables_and_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).count() == 0
    out = as_dicts(mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "s")], SCHEMA)).select(*OUT))
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in out] == [(0, 0, 0.0, 0)] * 2
