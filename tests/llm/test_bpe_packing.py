import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from driftline.llm import bpe, packing

ODD = [None, "", " ", "a", "  two  spaces ", "line\n\nline \t x", "naïve 中文 😀é", "it's we'll 're", "<|endoftext|> </s>", "###%%% $$$", "\x85　\x1c x", "same", "same", "x" * 5000, "ab " * 3000]
SCHEMA = "doc_id long, text string, n_tokens string, ids string, piece string, length string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_encodes_as_tiktoken_and_decodes(spark, ranks):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spec = bpe.from_ranks(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rows = bpe.decode(bpe.encode(frame(spark, ODD), spec, offsets=True), spec).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        text = ODD[row["doc_id"]] or ""
        assert row["ids"] == own.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()
        assert all(a < b for a, b in zip(row["starts"], row["ends"], strict=True))
        assert not text or (row["starts"][0], row["ends"][-1]) == (0, len(text))
        assert "".join(bpe.byte_table(spec).pieces(row["ids"])) == text
    assert bpe.encode(frame(spark, []), spec).count() == 0


def test_random_texts_encode_as_tiktoken(ranks):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = bpe.Encoder(bpe.from_ranks(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    draw = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "#", "###", "=", "中", "😀", "1", "23", "'s", ".", "the ", "\r\n", "​", "\x00", "ﬁ", "न", "०"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_remembered_chunks_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 10)
    spec = bpe.from_file(P.path("byte_bpe_50k.json"))
    plain, e = Tokenizer.from_str(spec), bpe.Encoder(spec)
    plain.encode_special_tokens = True
    for k in range(5):
        texts = [f"doc {k} has words{k} and {j} more" for j in range(30)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def check_packed(rows, texts, length=1024):
    spec = bpe.from_file(P.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_str(spec)
    plain.encode_special_tokens = True
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert docs.keys() == set(range(len(texts)))
    for k, parts in docs.items():
        ids = [*plain.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert len(parts) == -(-len(ids) // length) and all(r["length"] == length for r in parts[1:])
        at = 0
        for r in parts:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_packs_whole_documents(spark):
    draw = random.Random(5)
    texts = ODD + [" ".join(draw.choice(["alpha", "beta", "gamma", "x"]) for _ in range(draw.choice([3, 200, 700, 2500]))) for _ in range(60)]
    spec = bpe.from_file(P.path("byte_bpe_50k.json"))
    check_packed(packing.pack_documents(frame(spark, texts), spec).collect(), texts)
    assert packing.pack_documents(frame(spark, []), spec).count() == 0


def bins_of(counts, length):
    return max((r[3] + r[2] for r in packing.plan(np.array(counts, "i8"), length)), default=0)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_as_good_as_exhaustive_search(seed):
    draw, length = random.Random(seed), 12
    sizes = sorted((draw.randrange(1, 12) for _ in range(9)), reverse=True)
    counts = np.bincount(sizes, minlength=length + 1)

    def least(rest, bins):
        if not rest:
            return len(bins)
        found = len(rest) + len(bins)
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + rest[0] <= length:
                found = min(found, least(rest[1:], bins[:i] + [bins[i] + rest[0]] + bins[i + 1 :]))
        return min(found, least(rest[1:], [*bins, rest[0]]))

    assert bins_of(counts, length) <= least(sizes, []) + 1
    assert hashlib.md5(repr(packing.plan(counts, length)).encode()).digest() == hashlib.md5(repr(packing.plan(counts, length)).encode()).digest()
    for k in range(1, length + 1):
        assert sum(r[2] * r[5] for r in packing.plan(counts, length) if r[0] == k) == counts[k]


def least_of(sizes, length):
    """The fewest bins by trying every place of every piece."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + sizes[k] <= length:
                place(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1 :])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("n", [2, 1000, 10**6])
def test_plan_goes_back_on_skewed_lengths(n):
    """The filling of least waste around the longest piece, {408, 306, 306}, leads to 3.5 n sequences."""
    counts = np.zeros(1025, "i8")
    counts[[306, 357, 408]] = 2 * n, 4 * n, 2 * n
    rows = packing.plan(counts)
    assert bins_of(counts, 1024) == 3 * n
    assert {k: sum(r[2] * r[5] for r in rows if r[0] == k) for k in (306, 357, 408)} == {306: 2 * n, 357: 4 * n, 408: 2 * n}
    assert packing.pack_counts(counts)[1] <= 3 * n


@pytest.mark.parametrize("seed", range(40))
def test_search_that_ends_is_exact(seed):
    draw, length = random.Random(seed), 40
    sizes = sorted((draw.randrange(7, 21) for _ in range(10)), reverse=True)
    found, bound = packing.pack_counts(np.bincount(sizes, minlength=length + 1), length)
    assert sum(times for _, times in found) == bound == least_of(sizes, length)
    assert packing.least_sequences(np.bincount(sizes, minlength=length + 1), length) <= bound


def test_dominated_fillings():
    assert packing.dominated(1 << 5, [(4, 1)], 1) and not packing.dominated(1 << 6, [(4, 1)], 1)
    assert packing.dominated(1 << 8, [(4, 2)], 0) and not packing.dominated(1 << 4, [(4, 1)], 0)
    assert packing.dominated(1 << 1, [], 1) and not packing.dominated(1 << 2, [], 1)


def test_encoder_remembers_the_chunks_of_the_last_two_generations(monkeypatch):
    """What is remembered is bounded, and a chunk that is still in use is not encoded again when a task begins anew."""
    monkeypatch.setattr(bpe, "REMEMBER", 50)
    path = P.path("byte_bpe_50k.json")
    own, library, asked = bpe.Encoder(bpe.from_file(path)), Tokenizer.from_file(path), []
    library.encode_special_tokens = True
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda chunks: (asked.extend(chunks), learn(chunks)))
    for k in range(30):
        texts = [f"x common {k}a naïve{k} word{k}, and{k}", " ".join(f"w{k}q{i}" for i in range(8)), *[t or "" for t in ODD[:12]]]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.later) <= 50 + 40 and len(own.older) <= 50 + 40
    assert asked.count("common") == 1
