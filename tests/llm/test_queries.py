"""Every query of the subpackage on the smallest tables: against its SQL, or by its rows."""

from pathlib import Path

import duckdb
import pytest

from driftline.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op3_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op4_html_wrappers": {"page_id", "url", "text", "n_chars"},
    "op5_jaccard_join": {"doc_id", "n_shingles", "component_id"}, "op7_repair_files": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op9_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(str(v[k]) if v[k] is not None else "" for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name in queries.SQL:
        result = duck.execute(queries.SQL[name])
        assert rows(df.columns, [tuple(r) for r in got]) == rows([c[0] for c in result.description], result.fetchall())
        return
    assert COLUMNS[name] <= set(df.columns)
    table, key = ("pages", "page_id") if name.startswith("op4") else ("documents", "doc_id")
    ids = {r[0] for r in duck.execute(f"SELECT {key} FROM {table}").fetchall()}
    assert {r[key] for r in got} == ids and (name.startswith("op9") or len(got) == len(ids))
