import zlib

import numpy as np
import pytest

from driftline.llm import toxicity as x

DOCS = "doc_id long, text string, lang string, label string, score string, evidence string"


def dense(index):
    out = np.zeros((len(index.ids), len(index.terms)))
    for p in range(len(index.ids)):
        part = slice(index.starts[p], index.starts[p + 1])
        out[p, index.example_terms[part]] = index.example_weights[part]
    return out


@pytest.mark.parametrize("columns", [0, 8, 512])
def test_index_finds_the_nearest_of_brute_force(monkeypatch, columns):
    """Whole vectors, all terms: places and cosines are those of a full product."""
    monkeypatch.setattr(x, "COLUMNS", columns)
    draw = np.random.default_rng(1)
    index = x.Index([f"t{k}" for k in range(400)], draw.uniform(1, 6, 400))
    vectors = []
    for k in range(500):
        t = np.sort(draw.choice(400, draw.integers(1, 30), replace=False))
        vectors.append((k, int(draw.integers(0, 2)), t, index.vector(t, draw.integers(1, 9, len(t)))))
    index.build(vectors + vectors[:3])
    full = dense(index)
    for but in (None, [frozenset((5, 77))] * 120):
        found = index.nearest([(t, w) for _, _, t, w in vectors[:120]], but=but)
        for (_, _, t, w), (place, near) in zip(vectors, found, strict=False):
            cosine = full[:, t] @ w
            if but:
                cosine[list(but[0])] = 0
            best = np.lexsort((np.arange(len(cosine)), -cosine))[: x.NEIGHBOURS]
            assert np.allclose(near, cosine[best][: len(near)]) and np.all(cosine[best][len(near) :] <= 0)
            assert set(place[near > near[-1] + 1e-9]) == set(best[cosine[best] > near[-1] + 1e-9])


def test_terms_are_words_and_chosen_beginnings():
    terms = ["ab", "idio*", "idiot", "lowei*", "scum", "été"]
    t, n = x.Terms(terms).counts("Idiot, idiots! lowei loweiß LOWEIS xidiot idio-idiot été_ab ÉTÉ scum scum")
    assert {terms[i]: k for i, k in zip(t.tolist(), n.tolist(), strict=True)} == {"ab": 1, "idio*": 3, "idiot": 2, "lowei*": 2, "scum": 2, "été": 2}
    assert len(x.Terms([]).counts("idiot")[0]) == 0


def test_every_text_with_known_words_has_evidence(spark):
    path = "/root/testdata/sf0.001/"
    docs, labels = spark.read.parquet(path + "documents.parquet"), spark.read.parquet(path + "labels.parquet")
    index = x.fit(docs, labels)
    full, terms = dense(index), x.Terms(index.terms)
    for r in x.score(docs, index).collect():
        t, n = terms.counts(r["text"] or "")
        cosine = np.sort(full[:, t] @ index.vector(t, n) if len(t) else np.zeros(0))[::-1][: x.NEIGHBOURS]
        assert np.allclose([e["cosine"] for e in r["evidence"]], cosine[cosine > 0])
        assert len(t) == 0 or r["evidence"]


def test_held_out_accuracy(spark):
    """The score may not come from labels: on the held-out third it finds most toxic texts and leaves clean ones alone."""
    path = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(path + "documents.parquet"), spark.read.parquet(path + "labels.parquet")
    out = x.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    toxic, clean = [r for r in held if r["toxic"]], [r for r in held if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    examples = {e["example"] for r in out for e in r["evidence"]}
    assert examples and not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in examples)


@pytest.mark.parametrize("labelled", [True, False])
def test_nulls_empty_long_and_repeated_rows(spark, labelled):
    bad, good = "you are scum and trash my friend", "the weather is fine today my friend"
    rows = [(k, bad if k % 3 == 0 else good, None, "x", "y", "z") for k in range(60)]
    rows += [(100, None, "x", "y", "z", "w"), (101, "", "x", "y", "z", "w"), (102, "scum " * 20000, "x", "y", "z", "w"), (103, bad, None, None, None, None), (103, bad, None, None, None, None), (None, good, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(60)] + [(None, 1, 1), (3, None, None), (4, 0, 0)] if labelled else [], "doc_id long, quality int, toxic int")
    out = x.toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    if labelled:
        assert by[103]["predicted"] == 1 and by[102]["predicted"] == 1 and by[3]["predicted"] == 1
    assert by[None]["predicted"] == by[100]["predicted"] == by[101]["predicted"] == 0
    assert len({r["score"] for r in out if r["text"] == good}) == 1
    assert x.toxicity(docs.limit(0), labels).count() == 0


class Columns:
    """Stands for a table: notes the columns that are selected, and gives out the function that batches go through."""

    def __init__(self, schema):
        self.schema, self.columns = schema, schema.names

    def select(self, *columns):
        self.selected = columns
        return self

    def mapInArrow(self, run, schema):
        return run


def test_counting_lets_go_of_the_encoder_and_sends_a_kept_text_once(spark):
    """A worker that packed before has an encoder's memory, and a text that is kept has no second column."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from driftline.llm import bpe

    docs = Columns(T._parse_datatype_string("doc_id long, text string"))
    run = x.counted_terms(docs, ["a", "b"])
    assert docs.selected == ("doc_id", "text")
    bpe._ENCODERS[0] = "an encoder"
    out = next(run(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["b a b", None]})])))
    assert bpe._ENCODERS == {}
    assert out.to_pydict() == {"doc_id": [1, 2], "text": ["b a b", None], "_tx_terms": [[0, 1], []], "_tx_counts": [[1, 2], []]}
