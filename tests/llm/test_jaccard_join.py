import random
import re

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import jaccard_join as j

SCHEMA = "doc_id long, text string, class string, n_shingles string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def set_of(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


ODD = [None, "", " \t\n", "one", "One", "two words", "a b c d", "A b\tc  d", "a b c d e", "a b c d e f", "É b c d e", "é b c d e", "x " * 3000, "\xa0 a", "w" * 3000]


def test_sets_are_exact():
    made = j.shingle_sets(pa.array(ODD))
    assert [len(s) for s in made] == [len(set_of(t)) for t in ODD]
    same = {(a, b) for a in range(len(ODD)) for b in range(a) if np.array_equal(made[a], made[b])}
    assert same == {(a, b) for a in range(len(ODD)) for b in range(a) if set_of(ODD[a]) == set_of(ODD[b])}
    part = pa.array(["skip this one", *ODD]).slice(1)
    assert all(np.array_equal(a, b) for a, b in zip(made, j.shingle_sets(part), strict=True))


@pytest.mark.parametrize("seed", range(30))
def test_no_linked_pair_is_missed(seed):
    """Signatures of two sets with just enough in common always meet, whatever is dear."""
    draw = np.random.default_rng(seed)
    for _ in range(60):
        n = int(draw.choice([1, 2, 3, 4, 5, 7, 9, 12, 20, 35, 60, 150, 400]))
        x = np.unique(draw.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        m = int(draw.integers(-(-3 * n // 4), 4 * n // 3 + 1))
        both = -(-75 * (n + m) // 175)
        if both > min(n, m):
            continue
        y = np.unique(np.concatenate([draw.permutation(x)[:both], draw.integers(0, 2**63, m - both).astype(np.uint64)]))
        found = j.signatures([x, y])
        dear = np.sort(draw.permutation(found.value)[: len(found.value) // int(draw.choice([2, 5, 1000]))])
        found = j.signatures([x, y], dear)
        small = int(len(y) < len(x))
        if small in found.short or 100 * both < 75 * (len(x) + len(y) - both):
            continue
        mine, theirs = found.value[(found.owner == small) & found.probe], found.value[found.owner != small]
        assert np.isin(mine, theirs).any() or len(x) == len(y) and np.isin(found.value[(found.owner == 1) & found.probe], found.value[found.owner == 0]).any()


def corpus(seed, n=120):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [draw.choice(vocabulary) for _ in range(40)]
    rows, bases = [], []
    for k in range(n):
        kind = draw.random()
        if kind < 0.45 and bases:
            words = list(draw.choice(bases))
            for _ in range(draw.choice([0, 1, 2, 4, 8])):
                at = draw.randrange(len(words))
                words[at : at + draw.choice([0, 1])] = [draw.choice(vocabulary)] * draw.choice([0, 1, 2])
                words = words or ["w"]
        elif kind < 0.7:
            own = [draw.choice(vocabulary) for _ in range(draw.choice([8, 12, 20]))]
            words = own[: len(own) // 2] + shared + own[len(own) // 2 :]
        else:
            words = [draw.choice(vocabulary) for _ in range(draw.choice([3, 6, 10, 30, 100, 300]))]
        bases.append(words)
        rows.append((1000 - k if k % 2 else k, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_components_are_those_of_brute_force(spark, seed):
    rows = corpus(seed) + [(2000 + k, t) for k, t in enumerate(ODD)] + [(5, "repeated id here with words"), (5, "repeated id here with words")]
    assert got(j.near_duplicates(frame(spark, rows))) == brute(rows)


def test_dear_signatures_and_short_sets_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(j, "DEAR", 2)
    monkeypatch.setattr(j, "SEGMENTS_PER_SHINGLE", 0.36)
    monkeypatch.setattr(j, "SEGMENTS_MORE", 2)
    rows = corpus(7, 90)
    assert got(j.near_duplicates(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert j.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_a_segment_of_one_shingle_allows_no_difference(seed):
    """10 and 11 shingles, 9 shared: the first cheap segment lacks its only shingle, the other two have one more each."""
    draw = np.random.default_rng(seed)
    new = lambda n: draw.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
    m = int(j.segments_of(np.searchsorted(j._BANDS, [10], "right") - 1)[0])
    segment = lambda t: ((t >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype("i8")
    while True:
        x = np.unique(new(10))
        places, sizes = np.unique(segment(x), return_counts=True)
        if len(x) == 10 and len(places) >= 6 and places[0] < j.DELETION_SEGMENTS <= places[1] and sizes[0] == 1:
            break
    more = [next(t for t in new(1000) if segment(t) == place) for place in places[1:3]]
    y = np.unique(np.concatenate([x[segment(x) != places[0]], np.array(more, np.uint64)]))
    assert (len(y), len(np.intersect1d(x, y))) == (11, 9)
    dear = np.sort(j.signatures([x]).value[3 : len(places)])  # signatures of filled segments come first
    found = j.signatures([x, y], dear)
    mine, theirs = found.value[(found.owner == 0) & found.probe], found.value[found.owner == 1]
    assert 0 in found.short or np.isin(mine, theirs).any()


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with more and more changes: many pairs link, many nearly do, and blocks are small."""
    monkeypatch.setattr(j, "CHUNK", 64)
    monkeypatch.setattr(j, "NEAREST", 1)
    draw = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(draw.randrange(9)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    made = []
    pairs = j._cross_pairs
    monkeypatch.setattr(j, "_cross_pairs", lambda *a: (made.append(pairs(*a).count()), pairs(*a))[1])
    assert got(j.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id")) == brute(rows)
    assert made and max(made) < 700 * 20


def test_rows_not_ids_go(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near, far = text.replace("w30", "z"), " ".join(f"q{k}" for k in range(60))
    rows = [(3, text), (5, near), (5, far), (7, None), (7, None), (None, far.replace("q1 ", "r "))]
    left = j.drop_near_duplicates(frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted(((r[0] or 0, r[1] or "") for r in left)) == sorted([(3, text), (7, ""), (7, ""), (0, rows[5][1])])


def mixed_groups(spark, groups, members, width):
    """Groups of two components, with random sketches: (gid, v, root, probe) and the classes."""
    draw = np.random.default_rng(5)
    rows = [(g, g * members + i, g * members + (0 if i < members // 2 else members // 2), i % 3 > 0) for g in range(groups) for i in range(members)]
    rep = [(v, v, 500, draw.bytes(width)) for _, v, _, _ in rows]
    return spark.createDataFrame(rows, "gid long, v long, root long, probe boolean"), spark.createDataFrame(rep, "class long, doc long, n long, sketch binary")


def test_whole_groups_and_chunks_give_the_same_pairs(spark, monkeypatch):
    mixed, rep = mixed_groups(spark, 6, 30, 32)
    found = []
    for chunk in (512, 8):
        monkeypatch.setattr(j, "CHUNK", chunk)
        found.append(sorted((r["a"], r["b"]) for r in j._cross_pairs(mixed, rep, 10**6).distinct().collect()))
    assert found[0] == found[1] and len(found[0]) > 6 * 100


def test_sketches_of_small_mixed_groups_are_dealt_out_once(spark):
    """By class, to meet their rows, and by group; not once more on each side of a join of blocks."""
    mixed, rep = mixed_groups(spark, 40, 60, 4096)
    folder = spark.conf.get("spark.checkpoint.dir") + "/groups"
    mixed.write.parquet(f"{folder}/mixed")
    rep.write.parquet(f"{folder}/rep")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    j._cross_pairs(spark.read.parquet(f"{folder}/mixed"), spark.read.parquet(f"{folder}/rep"), 1).write.format("noop").mode("overwrite").save()
    assert written() - before < 2.5 * 40 * 60 * 4096
