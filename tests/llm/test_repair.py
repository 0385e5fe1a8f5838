import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from driftline.llm import bpe, repair


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(monkeypatch, seed):
    monkeypatch.setattr(repair, "LEAST", 2)
    draw = np.random.default_rng(seed)
    n = draw.integers(1, 40, 50)
    ids = draw.integers(0, 5, int(n.sum()))
    left, right, sequence, symbols = repair.compress(ids, np.cumsum(n), 5)
    grammar = repair.Grammar(5, left, right)
    assert len(left) and len(sequence) < len(ids)
    assert np.array_equal(grammar.expand(sequence), ids)
    at, ends = 0, np.cumsum(symbols)
    for k, size in enumerate(n.tolist()):
        mine = sequence[ends[k] - symbols[k] : ends[k]]
        assert np.array_equal(grammar.expand(mine), ids[at : at + size])
        a = int(draw.integers(0, size))
        b = int(draw.integers(a + 1, size + 1))
        assert np.array_equal(grammar.slice(mine, a, b), ids[at + a : at + b])
        at += size


def test_files_in_order_of_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_IDS", 3000)
    draw = random.Random(2)
    rows = [(draw.randrange(10**6), " ".join(draw.choice(["alpha", "beta", "gamma ray", "x"]) for _ in range(draw.choice([0, 1, 5, 300])))) for _ in range(150)]
    rows += [(7, None), (7, "again"), (7, "again"), (None, "no id"), (10**7, "long " * 9000), (10**6 + 1, "")]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, ids string, start string, block string")
    spec = bpe.from_file(P.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_str(spec)
    plain.encode_special_tokens = True
    path = str(tmp_path / "ids")
    repair.write_ids(docs, path, spec)
    got = sorted(repair.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([*plain.encode(t or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids"] in texts[r["doc_id"]]
        texts[r["doc_id"]].remove(r["ids"])
        at += r["n_tokens"]
    digests = {(r["start"], r["ids_crc32"]) for r in repair.read_ids(spark, path, digest=True).collect()}
    assert digests == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got}
    some = next(r for r in got if r["n_tokens"] > 200 and r["doc_id"] is not None)
    assert repair.read_document(spark, path, some["doc_id"], 17, 90) == some["ids"][17:90]
    assert repair.read_document(spark, path, some["doc_id"]) == some["ids"]
    with pytest.raises(KeyError):
        repair.read_document(spark, path, -1)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    repair.write_ids(docs, str(tmp_path / "none"), bpe.from_file(P.path("byte_bpe_50k.json")))
    assert repair.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_goes_on_until_no_pair_is_frequent():
    """A repeated passage and a run of one id end as a few symbols each, and no pair with LEAST places is left."""
    draw = np.random.default_rng(1)
    passage = draw.permutation(1000)
    parts = [*[np.concatenate([passage, draw.integers(1000, 1400, 3)]) for _ in range(400)], np.full(5000, 7), draw.integers(0, 1400, 20_000)]
    ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    left, right, sequence, symbols = repair.compress(ids, ends, 1400)
    grammar = repair.Grammar(1400, left, right)
    assert np.array_equal(grammar.expand(sequence), ids)
    assert np.array_equal(grammar.lengths, repair.expansion_lengths(1400, left, right))
    assert len(sequence) < 400 * 4 + 5000 // 256 + 20_000 and grammar.lengths.max() >= 1000
    inside = np.ones(len(sequence) - 1, bool)
    inside[np.cumsum(symbols)[:-1] - 1] = False
    pairs, counts = np.unique(np.stack([sequence[:-1], sequence[1:]])[:, inside], axis=1, return_counts=True)
    assert counts[pairs[0] != pairs[1]].max() < repair.LEAST
    assert counts[pairs[0] == pairs[1]].max(initial=0) < 2 * repair.LEAST
