"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from driftline import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(str(v[k]) if v[k] is not None else "" for k in order) for v in values))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_is_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(registry.SQL[name])
    expected = rows([c[0] for c in result.description], result.fetchall())
    assert got == expected


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
