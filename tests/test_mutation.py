"""Keyed permutations, exact counts, new mutations and tables of slots."""

import math

import pytest
from pyspark.sql import functions as F

from driftline.functions import draws
from driftline.functions.draws import binomial_count, permuted, poisson_count
from driftline.operators import mutation, reproduction
from driftline.sources import state


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1025, 3000])
def test_permutation_of_all_places(spark, n):
    got = [r["p"] for r in spark.range(n).select(permuted(F.col("id"), n, 5, "x").alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n > 64:
        other = [r["p"] for r in spark.range(n).select(permuted(F.col("id"), n, 6, "x").alias("p")).collect()]
        assert sum(a == b for a, b in zip(got, other, strict=True)) < n / 20 and sum(a == k for k, a in enumerate(got)) < n / 20


def test_large_permutation_and_null(spark):
    n = 10**15 + 7
    rows = spark.range(5000).select(permuted(F.col("id"), n, 1).alias("p"), permuted(F.lit(None).cast("long"), n, 1).alias("none"))
    got = [r["p"] for r in rows.collect()]
    assert len(set(got)) == 5000 and 0 <= min(got) and max(got) < n and abs(sum(got) / 5000 / n - 0.5) < 0.03
    assert rows.where("none is not null").count() == 0


def test_counts_follow_their_distributions():
    us = [(k + 0.5) / 20_000 for k in range(20_000)]
    for n, p in ((10, 0.3), (1000, 0.01), (10**9, 1e-6), (7, 0.9)):
        x = [binomial_count(u, n, p) for u in us]
        mean = sum(x) / len(x)
        assert abs(mean - n * p) < 0.02 * math.sqrt(n * p) and abs(sum((k - mean) ** 2 for k in x) / len(x) / (n * p * (1 - p)) - 1) < 0.02
    exact = [math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(11)]
    x = [binomial_count(u, 10, 0.3) for u in us]
    assert max(abs(x.count(k) / 20_000 - q) for k, q in enumerate(exact)) < 2e-4
    for mean in (0.5, 40, 1e6):
        x = [poisson_count(u, mean) for u in us[::10]]
        assert abs(sum(x) / len(x) - mean) < 0.03 * math.sqrt(mean)
    assert (binomial_count(0.5, 0, 0.5), binomial_count(0.5, 9, 0.0), binomial_count(0.5, 9, 1.0), poisson_count(0.5, 0.0)) == (0, 0, 9, 0)


def test_mutated_cells_are_distinct_and_of_both_axes(spark):
    haps, sites = spark.range(40).selectExpr("id * 3 AS hap_id"), spark.range(50).selectExpr("id * 7 AS slot")
    got = [tuple(r) for r in mutation.mutated_cells(haps, sites, 0.3, 2, "q", state.written).collect()]
    assert len(set(got)) == len(got) == binomial_count(draws.keyed_uniform(2, "q", "m"), 2000, 0.3)
    assert len({h for h, _ in got}) == 40 and len({s for _, s in got}) == 50 and all(h % 3 == 0 and s % 7 == 0 for h, s in got)
    assert mutation.mutated_cells(haps, sites.limit(0), 0.3, 2, "q", state.written).count() == 0
    assert mutation.mutated_cells(haps, sites, 1.0, 2, "q", state.written).distinct().count() == 2000


def test_new_mutations_take_the_lowest_free_slots(spark):
    free = spark.range(500).selectExpr("id * 2 AS slot")
    made = mutation.new_mutations(free, 1000, 0.02, 0.05, "fixed", 0.1, 4)
    rows = made.orderBy("slot").collect()
    trait, neutral = poisson_count(draws.keyed_uniform(4, "trait"), 20), poisson_count(draws.keyed_uniform(4, "neutral"), 50)
    assert [r.slot for r in rows] == [2 * k for k in range(trait + neutral)]
    assert [r.is_qtl for r in rows] == [True] * trait + [False] * neutral
    assert all(abs(r.alpha) == (0.1 if r.is_qtl else 0) and 0 <= r.hap < 1000 for r in rows)
    with pytest.raises(ValueError, match="capacity"):
        mutation.new_mutations(free.limit(10), 1000, 0.02, 0.05, "fixed", 0.1, 4)
    variants = free.selectExpr("slot", "1 AS chr", "CAST(slot AS INT) AS bp", "false AS is_qtl", "0.0D AS alpha", "false AS active")
    after, carriers = mutation.apply_mutations(variants, spark.createDataFrame([(900, 3)], "slot long, hap long"), made)
    assert after.where("active").count() == trait + neutral and after.count() == 500 and after.where("is_qtl").count() == trait
    assert carriers.count() == trait + neutral + 1


def test_first_tables_of_slots(spark):
    slots = spark.range(2000).selectExpr("id AS slot", "CAST(id % 4 AS INT) AS chr", "CAST(id AS INT) AS bp")
    rows = mutation.ism_initial(slots, 400, 0.01, 0.03, 300.0, "normal", 0.1, 3).collect()
    active = [r for r in rows if r.active]
    assert len(rows) == 2000 and len(active) == poisson_count(draws.keyed_uniform(3, "sites"), 300.0)
    assert sum(r.is_qtl for r in rows) == binomial_count(draws.keyed_uniform(3, "traits"), len(active), 0.25)
    assert all(r.active or (not r.is_qtl and r.alpha == 0 and r.p == 0) for r in rows) and all(1 / 400 <= r.p < 1 for r in active) and all((r.alpha != 0) == r.is_qtl for r in rows)
    assert mutation.ism_initial(slots, 400, 0.01, 0.03, 300.0, "normal", 0.1, 3, denovo=True).where("active or p > 0").count() == 0
    assert mutation.ism_initial(slots.limit(5), 400, 0.01, 0.03, 300.0, "normal", 0.1, 3).where("active").count() == 5
    recap = mutation.recap_sites(slots, 77, "fixed", 0.1, 1, True)
    assert recap.where("is_qtl and active and abs(alpha) = 0.1D").count() == 77 and recap.where("active").count() == 77
    assert mutation.recap_sites(slots, 77, "fixed", 0.1, 1, False).where("active").count() == 2000
    with pytest.raises(ValueError, match="77 trait sites and 5 slots"):
        mutation.recap_sites(slots.limit(5), 77, "fixed", 0.1, 1, True)


def test_edges_at_variants(spark):
    variants = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 2, 1)], "slot long, chr int, bp int")
    points = spark.createDataFrame([(5, 1, 3), (5, 1, 10), (5, 1, 11), (5, 1, 30), (5, 2, 1), (6, 1, 20)], "gamete long, chr int, bp int")
    cut = reproduction.edges_at_variants(spark.createDataFrame([(5,), (6,), (7,)], "gamete long"), variants, points, 50, 1).collect()
    by = {}
    for r in sorted(cut, key=lambda r: (r.gamete, r.chr, r.left)):
        by.setdefault((r.gamete, r.chr), []).append((r.left, r.right, r.strand))
    # two crossovers act at 10 and leave the strand, one at 20 changes it, that at 30 acts at none
    (a, b, c) = by[5, 1]
    assert [x[:2] for x in (a, b, c)] == [(1, 10), (10, 20), (20, 51)] and a[2] == b[2] != c[2]
    assert [x[:2] for x in by[5, 2]] == [(1, 51)] and [x[:2] for x in by[6, 1]] == [(1, 20), (20, 51)] and by[6, 1][0][2] != by[6, 1][1][2]
    assert [x[:2] for x in by[7, 1]] == [(1, 51)] == [x[:2] for x in by[7, 2]]
