import corpus_pipeline as p
from driftline.llm import toxicity
from tests.llm.test_bpe_packing import check_packed
from tests.llm.test_jaccard_join import brute

PATH = "/root/testdata/sf0.001"


def quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    from collections import Counter

    often = Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if often[g] > 1 for d in range(3)}
    if len(words) < 50 or 100 * len(covered) > 50 * len(words):
        return False
    lost = 0
    for line in (text or "").split("\n"):
        n, symbols = len(re.findall(r"[^\x20\x09-\x0D]+", line)), sum(line.count(c) for c in "#*$%&|<>")
        bars = sum(line.count(c) for c in "|»•›·")
        bad = bars >= 3 and n <= 2 * (bars + 1) or symbols > n * 0.5 or n <= 3 and not re.search(r"[.!?:;,\"')\]…。！？”»]$", line.rstrip(" \t\x0b\x0c\r"))
        bad = bad or any(re.search(b.replace(" ", r"\s+"), line.lower()) for b in ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "click here", "sign up for our newsletter", "skip to content"))
        lost += n if n and bad else 0
    return 100 * lost <= 50 * len(words)


def test_pipeline_is_its_stages(spark):
    """The rows of run() are those of plain Python on what the toxicity operator left, and decisions take effect."""
    docs = spark.read.parquet(PATH + "/documents.parquet")
    toxic = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, spark.read.parquet(PATH + "/labels.parquet")).collect()}
    left = {r["doc_id"]: r["text"] for r in docs.collect() if not toxic[r["doc_id"]]}
    assert len(left) < docs.count()
    left = {i: t for i, t in left.items() if quality(t)}
    last = {}
    for i in sorted(left):
        last[left[i] or ""] = i
    left = {i: t for i, t in left.items() if last[t or ""] == i}
    left = dict(sorted((i, left[i]) for i, _, root in brute(sorted(left.items())) if i == root))
    rows = p.run(spark, PATH).collect()
    assert {r["doc_id"] for r in rows} == left.keys()
    ids = {i: k for k, i in enumerate(left)}
    check_packed([{**r.asDict(), "doc_id": ids[r["doc_id"]]} for r in rows], list(left.values()))


def test_stages_return_documents(spark):
    docs = spark.read.parquet(PATH + "/documents.parquet").limit(0)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, PATH)
        assert out.columns == list(p.COLUMNS) and out.count() == 0, name
    assert p.STAGES[-1][1](spark, docs, PATH).count() == 0
