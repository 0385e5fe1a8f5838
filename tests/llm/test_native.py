"""The operators that are DataFrame expressions, against brute force on awkward rows."""

import hashlib
import json
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.llm import chat_format, exact_dedup, line_dedup, quality_rules

LONG = "The same words come again and again. " * 4000
TEXTS = [
    (1, "a\nb\nc"), (2, "x\na\nb\ny"), (3, "a\nb\nc"), (4, None), (5, ""), (6, " \n\t\n"), (7, "p\np\np\np"), (8, "a\n\nb\nz"), (9, "b\nc\nq\n"), (10, LONG),
    (11, LONG), (12, "\n".join(f"line{k} of text{k} has{k} its own{k} words{k}." for k in range(60))), (13, "Menu | Home | News | About\n" * 20 + "one two three"), (14, "%%% a### b$$$ " * 30),
    (15, "ok\r\nwell now.\x0b tail\x0c x"), (16, "é" * 100 + "\nCookie  policy applies here to all of us now"), (17, "a\nb\nc\n"),
]
CLASH = ["n_words", "kept", "clean_text", "keep_id", "turns", "layout", "formatted", "n_lines", "removed_lines"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("own") for c in CLASH})


def with_sql(sql, table, rows, columns):
    con = duckdb.connect()
    con.register("_t", pa.table(dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True))))
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM _t")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    return sorted((dict(zip(names, r, strict=True)) for r in result.fetchall()), key=str)


def as_dicts(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def test_exact_dedup(spark, docs):
    assert as_dicts(exact_dedup.exact_duplicates(docs, digest_all=True)) == with_sql(exact_dedup.SQL, "documents", TEXTS, ["doc_id", "text"])
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    kept = {r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()}
    assert kept == {i for i, _ in TEXTS} - {1, 4, 10}
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns


def test_exact_dedup_of_repeated_and_null_ids(spark):
    rows = [(1, "x"), (1, "x"), (1, "y"), (None, "x"), (2, "z"), (None, "n"), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.exact_duplicates(df, digest_all=True).collect()
    assert len(out) == len(rows)
    groups = Counter((r["text_sha256"], r["kept"]) for r in out)
    assert all(groups[hashlib.sha256(t.encode()).hexdigest(), True] == 1 for t in "xyzn")
    assert {(r["keep_id"], r["group_size"]) for r in out if r["text_sha256"] == hashlib.sha256(b"x").hexdigest()} == {(1, 3)}
    assert sorted(r["text"] for r in exact_dedup.drop_exact_duplicates(df).collect()) == ["n", "x", "y", "z"]


def test_exact_dedup_beyond_the_broadcast_bound(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    assert as_dicts(exact_dedup.exact_duplicates(docs, digest_all=True)) == with_sql(exact_dedup.SQL, "documents", TEXTS, ["doc_id", "text"])


def test_quality_rules(docs):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = quality_rules.quality_rules(docs)
    assert as_dicts(out.select(*names)) == with_sql(quality_rules.SQL, "documents", TEXTS, ["doc_id", "text"])
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[4]["clean_text"] == "" and by[12]["kept"] and not by[13]["kept"] and not by[14]["kept"]
    assert by[13]["clean_text"] in ("one two three", "", "\none two three") or "Menu" not in by[13]["clean_text"]
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
    kept = quality_rules.drop_bad(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in by.items() if r["kept"]}


def test_line_dedup(docs):
    out = line_dedup.line_dedup(docs)
    got = as_dicts(out.select("doc_id", "n_lines", "removed_lines", "longest_run", F.sha2("clean_text", 256).alias("clean_sha256")))
    assert got == with_sql(line_dedup.SQL, "documents", TEXTS, ["doc_id", "text"])
    by = {r["doc_id"]: r["clean_text"] for r in out.collect()}
    assert by[1] == "a\nb\nc" and by[2] == "x\ny" and by[3] == "" and by[7] == "p" and by[8] == "\nz" and by[17] == ""
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_finds_long_runs(spark):
    rows = [(k, "\n".join(f"l{j}" for j in range(k, k + 40))) for k in (0, 5, 100, 3)] + [(100, "\n".join(f"l{j}" for j in range(100, 140))), (None, "l0\nl1")]
    out = {(r["doc_id"], r["removed_lines"], r["longest_run"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(None, 0, 0), (0, 2, 2), (3, 37, 37), (5, 38, 38), (100, 0, 0)} or out == {(None, 0, 0), (0, 2, 2), (3, 37, 37), (5, 40, 40), (100, 0, 0)}


TRICKY = ["plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "[\\\\INST]", "<<SYS>> <</SYS>>", "", "a\nb\\n\\b", "é😀[/INST]</s>"]


def test_chat_round_trip(spark):
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "tool\nx", "user", "assistant", "assistant", None, "a\\b"], TRICKY[c:] + TRICKY[:c], strict=True))]
    rows += [(9, 1, "user", None), (9, 1, "assistant", "b"), (9, 1, "assistant", "a"), (None, None, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat_format.format_chats(chat_format.records_of_turns(df))
    read = {r["conv_id"]: r for r in done.select("conv_id", "formatted", chat_format.read_formatted(F.col("formatted")).alias("turns"), chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in read:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [tuple(t) for t in read[c]["turns"]] == [(r, x) for _, r, x in mine]
        assert read[c]["loss"] == "".join(x for _, r, x in mine if r == "assistant")
        inner = re.sub(r"<\|im_(start|end)\|>", "", read[c]["formatted"], count=2 * len(mine))
        assert not re.search(r"</s>|\[INST\]|\[/INST\]|<<SYS>>|<\|im_", inner)


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}, {"turns": [{"speaker": "user", "utterance": "q"}, {"speaker": "bot", "utterance": "a"}]},
    ]
    rows = [(json.dumps(r), "x", "y") for r in records] + [('{"other": 1}', "x", "y"), (None, "x", "y"), ("not json", "x", "y"), ('{"messages": []}', "x", "y")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "payload string, turns string, layout string")).collect()
    for r in out[: len(records)]:
        assert [tuple(t) for t in r["turns"]] == [("user", "q"), ("assistant", "a")]
    assert all(r["turns"] is None and r["formatted"] is None for r in out[len(records) : -1])
    assert len({r["layout"] for r in out[: len(records)]}) == len(records)


def test_chats_with_long_texts_more_keys_and_pieces(spark):
    long = "ab[INST] " * 2_400_000
    payloads = [
        json.dumps({"messages": [{"role": "user", "content": long}, {"role": "assistant", "content": "yes"}]}),
        json.dumps({"id": 7, "messages": [{"role": "user", "name": "x", "content": "hi"}, {"role": "assistant", "content": "yo", "id": "a"}], "metadata": {"k": [1]}}),
        json.dumps({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}),
        json.dumps({"prompt": "p", "response": None}),
        json.dumps({"prompt": "p", "completion": long}),
        json.dumps({"odd": {"deep": [{"er": {"est": 1}}]}}),
        "[1]", "not json", "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(payloads)), "conv_id long, payload string")
    done = chat_format.format_chats(rows).select("conv_id", chat_format.read_formatted(F.col("formatted")).alias("turns"), chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {r["conv_id"]: (None if r["turns"] is None else [tuple(t) for t in r["turns"]], r["loss"]) for r in done}
    assert got[0] == ([("user", long), ("assistant", "yes")], "yes")
    assert got[1] == ([("user", "hi"), ("assistant", "yo")], "yo")
    assert got[2] == ([("user", "ab"), ("assistant", "c")], "c")
    assert got[3] == ([("user", "p"), ("assistant", "")], "")
    assert got[4] == ([("user", "p"), ("assistant", long)], long)
    assert all(got[k] == (None, None) for k in range(5, 10))
    assert chat_format.format_chats(rows.where("false")).count() == 0
    paths = spark.createDataFrame([(payloads[5],)], "p string").select(chat_format.field_paths(F.col("p")).alias("x")).first()["x"]
    assert paths == ["odd", "odd.deep", "odd.deep[].er"]


def test_line_dedup_takes_one_long_line_and_whole_documents(spark):
    long, short = " ".join(f"w{k}" for k in range(51)), " ".join(f"w{k}" for k in range(50))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, f"e\n{short}\nf"), (4, f"g\n{short}\nh"), (5, "only"), (6, "only"), (6, "only"), (7, "x\nonly\ny"), (8, None)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    clean = sorted((r["doc_id"], r["clean_text"]) for r in out)
    assert clean == [(1, f"a\n{long}\nb"), (2, "c\nd"), (3, f"e\n{short}\nf"), (4, f"g\n{short}\nh"), (5, "only"), (6, ""), (6, ""), (7, "x\nonly\ny"), (8, "")]


def json_like(rng, depth=3):
    kind = rng.randrange(9 if depth else 6)
    if kind < 4:
        return rng.choice(["a", "", 'say "hi"', "s", "{", "[1]", '{"role":"x"}', "\\", "\n\t", "é\u2028", "</s>[INST]", "null", "-1.5e3", "true"])
    if kind < 6:
        return rng.choice([1, -2.5, True, None, 10**20])
    if kind == 6:
        return [json_like(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["role", "content", "text", "messages", "x y", 'k"', "s"]): json_like(rng, depth - 1) for _ in range(rng.randrange(3))}


def test_texts_that_spell_json_stay_as_they_are(spark):
    """1000 random texts that look like JSON, numbers, code and calls, in each layout and from a table of turns."""
    rng = random.Random(4)
    texts = [rng.choice([json.dumps, lambda v: json.dumps(v, indent=1), str, repr])(json_like(rng)) for _ in range(990)]
    texts += ['{"a": 1}', '[{"x":1}]', "[]", "{}", "5", "null", '"quoted"', "def f():\n    return {'a': [1]}", '{"name": "search", "arguments": {"q": "[INST]"}}', '\\"s']
    pairs = list(zip(texts[::2], texts[1::2], strict=True))
    rows = [(k, t, r, x) for k, pair in enumerate(pairs) for t, (r, x) in enumerate(zip(("user", "assistant"), pair, strict=True))]
    records = chat_format.records_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "payload")
    shapes = [
        lambda q, a: {"messages": [{"role": "user", "content": q}, {"role": "assistant", "content": a}]},
        lambda q, a: {"prompt": q, "response": a, "split": "train"},
        lambda q, a: {"conversations": [{"from": "human", "value": q}, {"from": "gpt", "value": a}], "extra": {"deep": [1]}},
        lambda q, a: {"messages": [{"role": "user", "content": [{"type": "text", "text": q}]}, {"role": "assistant", "content": a}]},
    ]
    more = spark.createDataFrame([(1000 + k, json.dumps(shapes[k % 4](q, a))) for k, (q, a) in enumerate(pairs)], "conv_id long, payload string")
    done = chat_format.format_chats(records.unionByName(more))
    got = {r["conv_id"]: r for r in done.select("conv_id", chat_format.read_formatted(F.col("formatted")).alias("turns"), chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for k, (q, a) in enumerate(pairs):
        for c in (k, 1000 + k):
            assert [tuple(t) for t in got[c]["turns"]] == [("user", q), ("assistant", a)] and got[c]["loss"] == a
    sql = with_sql(chat_format.SQL, "conversations", rows, ["conv_id", "turn", "role", "text"])
    assert len(sql) == len(pairs) + 1


def test_contents_that_are_no_texts(spark):
    record = {"messages": [{"role": "user", "content": 5}, {"role": "tool", "content": {"a": "s[1]", "b": [True, None]}, "tool_calls": [{"function": {"name": "f"}}]}, {"role": "assistant", "content": None}]}
    rows = spark.createDataFrame([(1, json.dumps(record)), (2, '{"messages": 7}'), (3, '{"prompt": "a')], "conv_id long, payload string")
    got = {r["conv_id"]: r["turns"] for r in chat_format.format_chats(rows).collect()}
    turns = [tuple(t) for t in got[1]]
    assert turns[0] == ("user", "5") and turns[2] == ("assistant", "") and json.loads(turns[1][1]) == record["messages"][1]["content"]
    assert got[2] is None and got[3] is None
    assert chat_format.records_of_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_batches_of_texts_are_bounded_unless_the_session_says_otherwise(spark):
    from driftline.llm import _tables

    own = spark.newSession()
    _tables.ship(own)
    seen = own.range(5000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").toArrow()["n"].to_pylist()
    assert sum(seen) == 5000 and max(seen) == _tables.BATCH_ROWS
    own.conf.set(_tables.RECORDS, "3000")
    _tables.ship(own)
    assert own.conf.get(_tables.RECORDS) == "3000"
