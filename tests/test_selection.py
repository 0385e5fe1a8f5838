"""Scoped tests under sign flips against numpy, placement and draws."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from driftline import registry
from driftline.operators import ancestry, gram, initial, ld, ranges, selection
from driftline.plans import populations
from driftline.sources import archive, state


def population(spark, p=6, n=40, demes=2, seed=1):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (n, p))
    geno = spark.createDataFrame([(i, i % demes, j + 1, int(g[i, j])) for i in range(n) for j in range(p)], "ind_id long, deme long, slot long, g int")
    rows = [(j + 1, 1 + j % 2, 10 * j + 1, float(rng.normal()), float(g[:, j].mean() / 2)) for j in range(p)]
    return g, rows, geno, spark.createDataFrame(rows, "slot long, chr int, bp int, alpha double, p double")


def test_points_are_those_of_numpy(spark):
    g, rows, geno, sites = population(spark)
    n_perm, n = 30, len(g)
    r = sum(20 / n * np.cov(g[np.arange(n) % 2 == d].T) for d in (0, 1))
    chr_, bp, a, p = (np.array([row[k] for row in rows]) for k in (1, 2, 3, 4))
    e = np.stack([selection.sign_row(j + 1, n_perm, 1) for j in range(len(a))]).astype("f8")
    same = chr_[:, None] == chr_[None]
    masks = {"genome": np.ones_like(same), "within": same, "win_40pct": same & (abs(bp[:, None] - bp[None]) <= 20)}
    y = np.clip(np.where(a > 0, p, 1 - p), 0.005, 0.995)
    got = {(x.scope, x.perm): x for x in selection.sign_flip_points(geno, sites, (40.0,), 100, n_perm).collect()}
    assert len(got) == 3 * (n_perm + 1)
    for scope, mask in masks.items():
        ea = e * a[:, None]
        b = ea * ((r * mask * ~np.eye(len(a), dtype=bool)) @ ea)
        x = b / b[:, 1:].std(axis=1, ddof=1, keepdims=True)
        for k in range(n_perm + 1):
            point = got[scope, k]
            assert point.b == pytest.approx(b[:, k].sum() / (np.diag(r) * a * a).sum())
            assert point.rho == pytest.approx(np.corrcoef(x[:, k], np.where(e[:, k] > 0, y, 1 - y))[0, 1])
            assert point.dir == pytest.approx((ea[:, k] * p).sum())


def test_tiles_blocks_and_block_signs(spark, monkeypatch):
    """Many small tiles and blocks of individuals give what one matrix gives; sites of a block share their signs."""
    monkeypatch.setattr(gram, "TILE", 4)
    monkeypatch.setattr(gram, "BLOCK", 7)
    g, rows, geno, sites = population(spark, p=11, n=50)
    n_perm, n = 12, len(g)
    r = sum(25 / n * np.cov(g[np.arange(n) % 2 == d].T) for d in (0, 1))
    chr_, bp, a, p = (np.array([row[k] for row in rows]) for k in (1, 2, 3, 4))
    blocks = [f"{c}:{min((b - 1) // 30, 3)}" for c, b in zip(chr_, bp, strict=True)]
    for block_bp, keys in ((None, [j + 1 for j in range(11)]), (30, blocks)):
        e = np.stack([selection.sign_row(k, n_perm, 3) for k in keys]).astype("f8") * a[:, None]
        want = {"genome": np.ones((11, 11), bool), "within": chr_[:, None] == chr_[None], "win_40pct": (chr_[:, None] == chr_[None]) & (abs(bp[:, None] - bp[None]) <= 20)}
        got = {(x.scope, x.perm): x for x in selection.sign_flip_points(geno, sites, (40.0,), 100, n_perm, 3, block_bp).collect()}
        for scope, mask in want.items():
            b = (e * ((r * mask * ~np.eye(11, dtype=bool)) @ e)).sum(0) / (np.diag(r) * a * a).sum()
            assert [got[scope, k].b for k in range(n_perm + 1)] == pytest.approx(b.tolist())
            assert [got[scope, k].dir for k in range(n_perm + 1)] == pytest.approx((e * p[:, None]).sum(0).tolist())
    q = sum(25 / n * np.corrcoef(g[np.arange(n) % 2 == d].T) for d in (0, 1)) * ~np.eye(11, dtype=bool)
    e = np.stack([selection.sign_row(j + 1, n_perm, 3) for j in range(11)]).astype("f8") * a[:, None]
    x, y = e * (q @ e), np.clip(np.where(a > 0, p, 1 - p), 0.005, 0.995)
    x /= x[:, 1:].std(axis=1, ddof=1, keepdims=True)
    for point in selection.sign_flip_points(geno, sites, (), 100, n_perm, 3, correlation=True).where("scope = 'genome'").collect():
        k = point.perm
        assert point.b == pytest.approx((e * ((r * ~np.eye(11, dtype=bool)) @ e)).sum(0)[k] / (np.diag(r) * a * a).sum())
        assert point.rho == pytest.approx(np.corrcoef(x[:, k], np.where(e[:, k] * a > 0, y, 1 - y))[0, 1])
    places = state.written(gram.numbered(sites), "places")
    made = gram.pairs(gram.products(gram.standardized(geno), places, state.written), places).collect()
    c = np.corrcoef(g.T)
    assert len(made) == 55 and all(x.r == pytest.approx(c[x.j - 1, x.k - 1]) for x in made)


def test_windows_on_tiles(spark, monkeypatch):
    """Covariances by deme and r2 of pairs in reach, with tiles that end inside chromosomes and windows."""
    monkeypatch.setattr(gram, "TILE", 3)
    monkeypatch.setattr(gram, "BLOCK", 5)
    g, rows, geno, sites = population(spark, p=14, n=24, demes=3)
    got = {(x.deme, x.j, x.k): x.cov for x in ld.covariances(geno, sites, 45, state.written).collect()}
    want = {}
    for d in range(3):
        c = np.cov(g[np.arange(24) % 3 == d].T)
        want |= {(d, j + 1, k + 1): c[j, k] for j in range(14) for k in range(14) if j != k and rows[j][1] == rows[k][1] and abs(rows[j][2] - rows[k][2]) <= 45}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    hap = geno.selectExpr("ind_id AS hap_id", "slot", "CAST(g > 0 AS INT) AS allele")
    x = (g > 0).astype("f8")
    p = spark.createDataFrame([(j + 1, rows[j][1], rows[j][2], float(x[:, j].mean())) for j in range(14)], "slot long, chr int, bp int, p double")
    r2 = {(v.j, v.k): v.r2 for v in ld.haplotype_r2(hap, p, 45, state.written).collect()}
    c = np.corrcoef(x.T) ** 2
    assert r2.keys() == {(j, k) for d, j, k in want if d == 0 and j < k} and all(v == pytest.approx(c[j - 1, k - 1]) for (j, k), v in r2.items())


def test_fewer_than_three_sites_give_no_rows(spark):
    _, _, geno, sites = population(spark)
    assert selection.sign_flip_points(geno, sites.where("slot <= 2"), (40.0,), 100, 5).count() == 0


def test_every_scope_has_a_row_without_enough_sites(spark, tmp_path):
    _, _, geno, sites = population(spark)
    few = sites.where("slot <= 2")
    tests = selection.every_scope(selection.selection_tests(selection.sign_flip_points(geno, few, (40.0,), 100, 5)), few, (40.0,))
    rows = {r.scope: r for r in tests.collect()}
    assert set(rows) == {"genome", "within", "win_40pct"} and all(r.n_loci == 2 and r.n_perm == 0 and r.b is None and r.rho_p is None and r["class"] == r.class_dir == "neutral" for r in rows.values())
    archive.write_keys(str(tmp_path / "few"), {"": tests.select("scope", "n_loci", "b", "class")}, {"": "scope"})
    read = {r.key: r.value for r in archive.read_summary(spark, [str(tmp_path / "few")]).collect()}
    assert read["genome.b"] == "NaN" and read["within.n_loci"] == "2" and read["win_40pct.class"] == "neutral"


def test_four_sites_have_b_but_no_rho(spark):
    _, _, geno, sites = population(spark)
    row = selection.selection_tests(selection.sign_flip_points(geno, sites.where("slot <= 4"), (), 100, 10)).where("scope = 'genome'").first()
    assert row.b is not None and row.b_p > 0 and row.dir_p > 0
    assert row.rho is None and row.rho_p is None and row.gate_p is None and row.plane_p is None and row["class"] == "neutral"


def test_scope_names():
    assert [selection.scope_name(w) for w in (5, 2.5, 50.0)] == ["win_5pct", "win_2p5pct", "win_50pct"]


def test_all_positions_are_used_when_sites_fill_them(spark):
    sites = spark.range(12).withColumnRenamed("id", "site")
    placed = initial.place_sites(sites.union(sites), 1, 12, 3, state.written).collect()
    assert sorted(r.bp for r in placed) == list(range(1, 13)) and sorted(r.site for r in placed) == list(range(12))
    with pytest.raises(ValueError, match="sites on a chromosome"):
        initial.place_sites(sites, 1, 11, 3, state.written)
    assert initial.place_sites(sites.limit(0), 1, 5, 3, state.written).count() == 0


def test_beta_draws_have_their_mean_and_least_share(spark):
    rows = spark.range(4000).select(initial.beta(0.4, 0.4, F.col("id"), 1, 0.05).alias("p"), initial.beta(0.6, 0.2, F.col("id"), 2).alias("q"), initial.beta(0, 0, F.col("id"), 2).alias("h")).collect()
    p, q = np.array([r.p for r in rows]), np.array([r.q for r in rows])
    assert p.min() >= 0.05 and p.max() <= 0.95 and abs(p.mean() - 0.5) < 0.02
    assert abs(q.mean() - 0.75) < 0.02 and abs(q.var() - 0.6 * 0.2 / (0.8**2 * 1.8)) < 0.01
    assert {r.h for r in rows} == {0.5}


def test_choice_is_of_that_many_sites(spark):
    sites = spark.range(100).withColumnRenamed("id", "site")
    assert initial.choose(sites, 30, 1).where("chosen").count() == 30
    assert initial.choose(sites, 200, 1).where("chosen").count() == 100
    assert sum(abs(r.e) for r in sites.select(initial.effects("fixed", F.col("site"), 1, 0.5).alias("e")).collect()) == 50.0
    with pytest.raises(ValueError, match="no kind"):
        initial.effects("other", F.col("site"), 1, 1.0)


def test_mutations_pass_down_covering_edges_in_order_of_generations(spark):
    edges = spark.createDataFrame([(1, 1, 10, 20, 0, 50), (2, 1, 20, 30, 10, 100), (2, 1, 20, 31, 40, 100), (3, 1, 10, 32, 0, 100)], "gen int, chr int, parent long, child long, left long, right long")
    begun = spark.createDataFrame([(1, 1, 20, 15), (1, 1, 20, 60), (1, 1, 20, 60), (2, 1, 10, 5)], "gen int, chr int, node long, bp long")
    got = sorted((r.node, r.bp) for r in ancestry.carry_down(begun, edges, ["bp"], [1, 2, 3], state.written).collect())
    assert got == [(10, 5), (20, 15), (20, 60), (30, 15), (30, 60), (31, 60), (32, 5)]


def test_ranges_carry_sums_and_next_values_over_groups(spark):
    rng = np.random.default_rng(2)
    data = [(int(g) if g else None, i, int(v) if v else None) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 4, 400), strict=True))]
    rows = spark.createDataFrame(data, "g int, i long, v int")
    sums = {r.i: r.s for r in ranges.running_sum(rows.fillna(0, ["v"]), ["g"], ["i"], "v", "s").collect()}
    following = {r.i: r.n for r in ranges.next_known(rows, ["g"], ["i"], "v", "n").collect()}
    for g, i, _ in data:
        assert sums[i] == sum(v or 0 for h, j, v in data if h == g and j <= i)
        assert following[i] == next((v for h, j, v in data if h == g and j >= i and v is not None), None)
    assert ranges.next_known(rows.limit(0), ["g"], ["i"], "v", "n").count() == 0


@pytest.mark.parametrize("positions", [70, 30])
def test_placement_and_first_slots_are_their_sql_where_rounds_leave_sites_over(spark, monkeypatch, positions):
    """Many sites a position, and more sites than positions: the queries end after the rounds of their SQL."""
    before = populations._place_sql()
    monkeypatch.setattr(populations, "PLACED_LEN", positions)
    now = populations._place_sql()
    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    con = duckdb.connect()
    for name in ("part", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    for name in ("placed_sites", "ism_initial"):
        got = registry.QUERIES[name](spark, sf)
        want = con.execute(registry.SQL[name].replace(before, now))
        columns = [c[0] for c in want.description]
        want = want.fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
        assert len(want) < parts
