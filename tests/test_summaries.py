"""Coalescence in local trees, configurations and checks of runs, and genealogies that drop what is done."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import ancestry, coalescence, configurations
from driftline.sources import state


def random_genealogy(seed, samples=9, positions=40):
    """A tree for each of a few stretches over shared inner nodes; edges of neighbouring stretches are joined where equal."""
    rng = random.Random(seed)
    time = {k: 0.0 for k in range(samples)} | {100 + k: 1.0 + k for k in range(12)}
    cuts = [1, *sorted(rng.sample(range(2, positions), 4)), positions + 1]
    edges, open_at = [], {}
    for left, right in zip(cuts, cuts[1:]):
        above = {}
        live = list(range(samples))
        for node in range(100, 112):
            if len(live) > 1:
                kids = rng.sample(live, min(len(live), rng.choice([1, 2, 2, 3])))
                above |= {k: node for k in kids}
                live = [k for k in live if k not in kids] + [node]
        for child, parent in above.items():
            before = open_at.get((child, parent))
            if before and before[1] == left:
                before[1] = right
            else:
                open_at[child, parent] = [left, right]
                edges.append((child, parent, open_at[child, parent]))
    return [(1, a[0], a[1], parent, child) for child, parent, a in edges], time, cuts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_meet_where_brute_force_says(spark, seed):
    edges, time, cuts = random_genealogy(seed)
    deme = {k: "ab"[k % 2] if k else "c" for k in range(9)}
    sums = {True: [0.0, 0], False: [0.0, 0]}
    for left, right in zip(cuts, cuts[1:]):
        above = {child: parent for _, a, b, parent, child in edges if a <= left < b}
        line = {k: [k] for k in range(9)}
        for k in line:
            while line[k][-1] in above:
                line[k].append(above[line[k][-1]])
        for i, j in itertools.combinations(range(9), 2):
            met = next((v for v in line[i] if v in line[j]), None)
            if met is not None:
                sums[deme[i] == deme[j]][0] += time[met] * (right - left)
                sums[deme[i] == deme[j]][1] += right - left
    frame = lambda rows, shape: spark.createDataFrame(rows, shape)
    args = frame(edges, "chr int, left long, right long, parent long, child long"), frame(list(time.items()), "node long, time double"), frame(list(deme.items()), "node long, deme string")
    (got,) = coalescence.mrca_fst(coalescence.coalescence_sums(*args, state.written)).collect()
    within, between = (sums[k][0] / sums[k][1] for k in (True, False))
    assert (got.t_within, got.t_between, got.fst) == pytest.approx((within, between, 1 - within / between))
    (none,) = coalescence.mrca_fst(coalescence.coalescence_sums(args[0].limit(0), args[1], args[2], state.written)).collect()
    assert none.t_within is None and none.fst is None


def test_trees_that_are_none_are_errors(spark):
    nodes, samples = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.0)], "node long, time double"), spark.createDataFrame([(1, "a")], "node long, deme string")
    shape = "chr int, left long, right long, parent long, child long"
    for rows, said in (([(1, 1, 9, 2, 1), (1, 5, 9, 3, 1)], "two parents"), ([(1, 1, 9, 1, 2)], "not older")):
        with pytest.raises(Exception, match=said):
            coalescence.coalescence_sums(spark.createDataFrame(rows, shape), nodes, samples, state.written).collect()


#: For each rule a change of the usual settings that breaks it.
BROKEN = {
    "n": {"n": 0}, "ne": {"ne": 0}, "n_chr": {"n_chr": 0}, "chr_len": {"chr_len": 0}, "f_neutral": {"f_neutral": 1.0}, "f_neutral_needs_traits": {"f_neutral": 0.5, "n_qtl": 0, "u_qtl": 0.0}, "f_neutral_or_n_neutral": {"f_neutral": 0.5, "n_neutral": 7},
    "n_qtl": {"n_qtl": -1}, "n_neutral": {"n_neutral": -1}, "some_sites": {"n_qtl": 0, "u_qtl": 0.0}, "sites_fit": {"n_qtl": 10**8}, "capacity": {"mutation_model": "infinite_sites", "init": "ism_denovo", "n_chr": 0},
    "capacity_fits": {"mutation_model": "infinite_sites", "init": "ism_denovo", "ism_capacity": 10**9}, "crossovers": {"crossovers": -1.0}, "u_qtl": {"u_qtl": -0.1}, "u_neutral": {"u_neutral": -0.1}, "u_qtl_needs_traits": {"n_qtl": 0, "n_neutral": 5},
    "neutral_needs_rate": {"n_neutral": 5, "u_neutral": 0.0}, "rate_needs_neutral": {"u_neutral": 0.1}, "maf_min": {"maf_min": 0.5}, "effect_scale": {"effect_scale": 0.0}, "h2": {"h2": 1.0}, "vs_ratio": {"vs_ratio": 0.0},
    **{name: {name: "other"} for name in configurations.NAMES}, "recap_needs_init": {"recap": True}, "recap_or_load": {"recap": True, "loads": True, "init": "from_recap"}, "init_needs_recap": {"init": "from_recap"}, "recap_burnin": {"recap_burnin": -1},
    "infinite_init": {"mutation_model": "infinite_sites"}, "finite_init": {"init": "ism_watterson"}, "ism_capacity": {"ism_capacity": -1}, "ism_cleanup": {"ism_cleanup": 0}, "init_p": {"init": "fixed_p", "init_p": 1.5}, "init_p_maf": {"init": "fixed_p", "init_p": 0.001},
    "outputs": {"outputs": ["plink", "paper"]}, "n_perm": {"n_perm": 0}, "memory_threshold": {"memory_threshold": 0}, "windows": {"windows": [5.0, 0.0]}, "test_maf_min": {"test_maf_min": -0.1}, "block_kb": {"block_kb": -1.0}, "simplify_every": {"simplify_every": 0},
    "b_scopes": {"b_scopes": ["win_xpct"]}, "rho_scopes": {"rho_scopes": ["near"]}, "some_b_scope": {"b_scopes": []}, "some_rho_scope": {"rho_scopes": []}, "some_phase": {"phases": []}, "phases": {"phases": ["later"]}, "phases_once": {"phases": ["init", "init"]},
    "gen_eq": {"gen_eq": -1}, "gen_dir": {"gen_dir": -1}, "gen": {"gen": -1}, "one_clock": {"gen": 5, "gen_eq": 5}, "half_lives_directional": {"half_lives": [0.5]}, "half_lives": {"half_lives": [0.0], "selection": "directional"}, "n_int": {"n_int": -2},
    "grid": {"grid": 0}, "panmictic_grid": {"grid": 2}, "demes_grid": {"demography": "twoD_perp"}, "recent": {"demography": "twoD_recent", "grid": 2}, "migration": {"demography": "twoD_perp", "grid": 2, "migration": -0.1}, "emigration": {"demography": "twoD_perp", "grid": 2, "migration": 0.3},
    "expansion": {"expansion": 0.5}, "expansion_end": {"expansion": 2.0, "expansion_before_end": -1}, "expansion_grows": {"expansion": 1.00001},
}


def test_every_rule_can_be_broken_and_the_usual_settings_break_none(spark):
    assert set(BROKEN) == set(configurations.RULES)
    kinds = {k: kind for k, (kind, _) in configurations.SETTINGS.items()}
    usual = {k: list(v) if isinstance(v, tuple) else v for k, (_, v) in configurations.SETTINGS.items()}
    rows = [("usual", usual), ("shared", usual | {"f_neutral": 0.5, "n_neutral": 1000}), ("recap", usual | {"recap": True, "init": "from_recap", "recent": 8, "demography": "twoD_recent", "grid": 3, "migration": 0.25})]
    rows += [(name, usual | change) for name, change in BROKEN.items()]
    table = spark.createDataFrame([(name, *[row[k] for k in kinds]) for name, row in rows], ", ".join(["config string", *[f"`{k}` {kind}" for k, kind in kinds.items()]]))
    got = {}
    for r in configurations.violations(table, "config").collect():
        got.setdefault(r.config, set()).add(r.rule)
    assert not {"usual", "shared", "recap"} & set(got)
    assert all(name in got.get(name, ()) for name in BROKEN), [name for name in BROKEN if name not in got.get(name, ())]
    made = {r.config: r for r in configurations.derived(table).collect()}
    assert made["shared"].n_neutral == 1000 and made["usual"].theta_qtl == pytest.approx(4 * 5000 * 0.01 / 1000) and made["usual"].theta_neutral == 0
    assert made["shared"].theta_neutral == pytest.approx(made["shared"].theta_qtl) and made["recap"].recap_burnin == 8 and made["recap"].n_total == 45_000
    assert configurations.violations(spark.range(3).withColumnRenamed("id", "config"), "config").count() == 0


def test_neutral_runs_have_two_checks(spark):
    rows = spark.createDataFrame([(1, True), (2, False)], "run long, neutral boolean").selectExpr("*", "100L AS n", "100L AS ne", "2L AS grid", "0.1D AS migration", "0.5D AS u", "10.0D AS vs", "1.0D AS vp", "0.5D AS va_breeding", "0.5D AS h2", "0.01D AS alpha_sq", "0.08D AS alpha_abs", "0.3D AS shift")
    metrics = configurations.run_metrics(rows)
    made = {r.run: r for r in metrics.collect()}
    assert made[1].strength == "none" and made[1].half_life == float("inf") and made[2].strength == "weak to moderate"
    assert made[2].ne_eff == pytest.approx(400 * 40 / 41) and made[2].beta_0 == pytest.approx(0.03)
    counts = {r["run"]: r["count"] for r in configurations.run_checks(metrics, "run").groupBy("run").count().collect()}
    assert counts == {1: 2, 2: 12}


@pytest.mark.parametrize("seed", [1, 2])
def test_descents_that_drop_nodes_are_those_that_keep_all(spark, seed):
    rng = random.Random(seed)
    edges = [(g, 1, p, k, a, a + rng.randrange(0, 40)) for g in range(1, 6) for p, k, a in [(rng.randrange(12), rng.randrange(12), rng.randrange(60)) for _ in range(25)]]
    begun = [(rng.randrange(1, 6), 1, rng.randrange(12), rng.randrange(60), i) for i in range(40)]
    e = spark.createDataFrame(edges, "gen int, chr int, parent long, child long, left long, right long")
    b = spark.createDataFrame(begun, "gen int, chr int, node long, bp long, i long")
    samples = spark.createDataFrame([(k,) for k in (0, 3, 3, 7)], "node long")
    args = (b, e, ["bp", "i"], [1, 2, 3, 4, 5], state.written)
    whole = ancestry.carry_down(*args).where("node in (0, 3, 7)")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, ancestry.carry_down(*args, samples).collect()))


def test_edges_of_all_lengths_cover_their_places(spark):
    rng = random.Random(4)
    edges = [(1, a, a + rng.choice([0, 1, 2, 3, 17, 64, 65, 100_000])) for a in (rng.randrange(-50, 2000) for _ in range(300))]
    sites = [(k, 1, rng.randrange(-60, 3000)) for k in range(80)]
    got = ancestry.covering_edges(spark.createDataFrame(sites, "site int, chr int, bp long"), spark.createDataFrame(edges, "chr int, left long, right long"))
    want = sorted((s, a, b) for s, _, p in sites for _, a, b in edges if a <= p < b)
    assert sorted((r.site, r.left, r.right) for r in got.collect()) == want
    assert ancestry.covering_edges(spark.createDataFrame(sites, "site int, chr int, bp long"), spark.createDataFrame([], "chr int, left long, right long")).count() == 0


@pytest.mark.parametrize("seed", [1, 4])
def test_large_trees_lose_their_lowest_nodes_and_keep_their_sums(spark, monkeypatch, seed):
    """Samples within the tree too; no task gets a row for each tip, and trees above the limit are cut round by round."""
    edges, time, _ = random_genealogy(seed, samples=14)
    deme = {k: "ab"[k % 2] if k else "c" for k in range(14)} | {101: "b", 103: "c"}
    frame = lambda rows, shape: spark.createDataFrame(rows, shape)
    args = frame(edges, "chr int, left long, right long, parent long, child long"), frame(list(time.items()), "node long, time double"), frame(list(deme.items()), "node long, deme string")
    sums = lambda: [tuple(r) for r in coalescence.coalescence_sums(*args, state.written).orderBy("chr", "stretch").collect()]
    whole = sums()
    for rows in (6, 1):
        monkeypatch.setattr(coalescence, "TREE_ROWS", rows)
        assert [pytest.approx(x) for x in sums()] == whole


def test_tips_of_one_parent_come_to_a_tree_as_one_row(spark, monkeypatch):
    seen = []
    trees = coalescence._trees
    monkeypatch.setattr(coalescence, "_trees", lambda cut, n: seen.append(cut.count()) or trees(cut, n))
    edges = spark.range(1000).selectExpr("1 AS chr", "1L AS left", "9L AS right", "2000 + id % 2 AS parent", "id AS child").union(spark.createDataFrame([(1, 1, 9, 3000, 2000), (1, 1, 9, 3000, 2001)], "chr int, left long, right long, parent long, child long"))
    nodes = spark.range(1000).selectExpr("id AS node", "0D AS time").union(spark.createDataFrame([(2000, 1.0), (2001, 2.0), (3000, 3.0)], "node long, time double"))
    (got,) = coalescence.coalescence_sums(edges, nodes, spark.range(1000).selectExpr("id AS node", "id % 2 AS deme"), state.written).collect()
    pairs = 500 * 499 / 2
    assert (got.within_time, got.within_pairs, got.all_time, got.all_pairs) == (3 * pairs, 2 * pairs, 3 * pairs + 3 * 250000, 1000 * 999 / 2)
    assert seen == [4]
