"""Registers mutation by number, tables of slots, recaps, merged panels and loaded bundles, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import catalog as c
from driftline.functions.draws import count_sql, permuted, permuted_sql
from driftline.functions.rng import uniform
from driftline.operators import ancestry, mutation, reproduction
from driftline.plans.populations import _bundle, _descent_sql, _generations, _place_sql, _q
from driftline.registry import QUERIES, SQL, register
from driftline.sources import bundle, state, views

RATES = {"trait": 0.02, "neutral": 0.05}


def keyed_permutation(s: SparkSession, d: str) -> DataFrame:
    """The place of each part among all parts in a keyed permutation, and of each order among the orders."""
    sized = lambda name, key: views.table(s, d, name).select(F.lit(name).alias("of"), F.col(key).alias("i")).crossJoin(F.broadcast(views.table(s, d, name).agg((F.max(key) + 1).alias("n"))))  # noqa: E731  # one row
    rows = sized("part", "p_partkey").unionByName(sized("orders", "o_orderkey"))
    return rows.select("of", "i", permuted(F.col("i"), F.col("n"), 3, "place").alias("place"))


register(
    "keyed_permutation",
    keyed_permutation,
    f"""WITH k AS (SELECT 'part' AS of, p_partkey AS i, max(p_partkey) OVER () + 1 AS n FROM part UNION ALL SELECT 'orders', o_orderkey, max(o_orderkey) OVER () + 1 FROM orders)
SELECT of, i, {permuted_sql('i', 'n', 3, 'place')} AS place FROM k""",
)


def mutation_cells(s: SparkSession, d: str) -> DataFrame:
    """Cells of the stored haplotypes that mutate, by pool: a Binomial number, drawn without replacement."""
    hap, variants = c._genotypes(s, d)
    pools = {"trait": variants.where("is_qtl"), "neutral": variants.where("not is_qtl")}
    made = [mutation.mutated_cells(hap, pools[name], rate, 9, name, state.written).withColumn("pool", F.lit(name)) for name, rate in RATES.items()]
    return made[0].unionByName(made[1]).select("pool", F.col("hap_id").cast("long").alias("hap_id"), F.col("slot").cast("long").alias("slot"))


def _pool_sql(name: str) -> str:
    rows = "is_qtl" if name == "trait" else "NOT is_qtl"
    source = f"s_{name} AS (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS r FROM variants WHERE {rows}), n_{name} AS (SELECT (SELECT count(*) FROM hp) * (SELECT count(*) FROM s_{name}) AS n, (SELECT count(*) FROM s_{name}) AS w)"
    count = count_sql(f"m_{name}", f"n_{name}", _q("=9", f"={name}", "=m"), f"(n * {RATES[name]}::DOUBLE)", "n")
    cells = f"c_{name} AS (SELECT {permuted_sql('i', 'n', 9, name)} AS cell, w FROM (SELECT unnest(range(count)) AS i, n, w FROM m_{name}, n_{name}))"
    return f"{source}, {count}, {cells}"


register(
    "mutation_cells",
    mutation_cells,
    f"WITH {c.V}, hp AS (SELECT hap_id, row_number() OVER (ORDER BY hap_id) - 1 AS h FROM (SELECT DISTINCT hap_id FROM hap)), {', '.join(map(_pool_sql, RATES))} "
    + " UNION ALL ".join(f"SELECT '{name}' AS pool, hap_id::BIGINT AS hap_id, slot::BIGINT AS slot FROM c_{name} JOIN hp ON h = cell // w JOIN s_{name} ON r = cell % w" for name in RATES),
)


def flip_by_number(s: SparkSession, d: str) -> DataFrame:
    """Carriers of each site before and after the cells of `mutation_cells` flip."""
    hap = views.haplotypes(s, d)
    after = reproduction.flip(hap.where("allele = 1"), mutation_cells(s, d))
    return hap.groupBy("slot").agg(F.sum("allele").alias("before")).join(after.groupBy("slot").agg(F.count(F.lit(1)).alias("after")), "slot", "left").select(F.col("slot").cast("long").alias("slot"), "before", F.coalesce("after", F.lit(0)).alias("after"))


register(
    "flip_by_number",
    flip_by_number,
    f"WITH mc AS ({SQL['mutation_cells']}), {c.V} SELECT slot::BIGINT AS slot, sum(allele)::BIGINT AS before, sum(CASE WHEN mc.slot IS NOT NULL THEN 1 - allele ELSE allele END)::BIGINT AS after FROM hap LEFT JOIN mc USING (hap_id, slot) GROUP BY slot",
)

TRAIT_RATE, NEUTRAL_RATE, SCALE = 0.004, 0.006, 0.05


def new_mutations(s: SparkSession, d: str) -> DataFrame:
    """New sites in the slots that no customer of segment BUILDING in debt holds, over two haplotypes for each customer."""
    slots, cells = c._slots(s, d)
    people = views.table(s, d, "customer")
    some = people.where("c_mktsegment = 'BUILDING' and c_acctbal < 0").select(F.col("c_custkey").alias("ind_id"))
    free = slots.join(cells.join(some, "ind_id", "left_semi").select("slot").distinct(), "slot", "left_anti")
    return c._rounded(mutation.new_mutations(free, 2 * people.count(), TRAIT_RATE, NEUTRAL_RATE, "exponential", SCALE, 13), "alpha")


_EFFECT = lambda seed, key: f"(-ln({_q(f'={seed}', '=e', key)}) * {SCALE}::DOUBLE * CASE WHEN {_q(f'={seed}', '=s', key)} < 0.5 THEN 1 ELSE -1 END)"
register(
    "new_mutations",
    new_mutations,
    f"""WITH {c._GENO2}, act AS (SELECT DISTINCT slot FROM geno2 JOIN customer ON c_custkey = ind_id WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0),
cp AS (SELECT 2 * count(*) AS copies FROM customer), {count_sql('mt', 'cp', _q('=13', '=trait'), f'(copies * {TRAIT_RATE}::DOUBLE)')}, {count_sql('mn', 'cp', _q('=13', '=neutral'), f'(copies * {NEUTRAL_RATE}::DOUBLE)')},
fr AS (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS k FROM parts WHERE slot NOT IN (SELECT slot FROM act))
SELECT slot, floor({_q('=13', '=hap', 'k')} * copies)::BIGINT AS hap, k < mt.count AS is_qtl, {c._r(f"CASE WHEN k < mt.count THEN {_EFFECT(13, 'slot')} ELSE 0 END")} AS alpha FROM fr, cp, mt, mn WHERE k < mt.count + mn.count""",
)


def _placed_slots(s: SparkSession, d: str) -> DataFrame:
    """Parts at drawn positions, as in `placed_sites`."""
    return QUERIES["placed_sites"](s, d).withColumnRenamed("site", "slot")


def ism_initial(s: SparkSession, d: str) -> DataFrame:
    """The first table of slots: a slot for each part, two haplotypes for each customer."""
    copies = 2 * views.table(s, d, "customer").count()
    expected = 0.02 * copies
    return c._rounded(mutation.ism_initial(_placed_slots(s, d), copies, TRAIT_RATE, NEUTRAL_RATE, expected, "exponential", SCALE, 17), "alpha", "p")


register(
    "ism_initial",
    ism_initial,
    f"""WITH pl AS ({_place_sql()}), cp AS (SELECT 2 * count(*) AS copies FROM customer), {count_sql('ms', 'cp', _q('=17', '=sites'), '(0.02::DOUBLE * copies)')},
nn AS (SELECT count(*) AS n FROM pl), so AS (SELECT least(n, ms.count) AS act, n FROM ms, nn), {count_sql('mt', 'so', _q('=17', '=traits'), f'(act * ({TRAIT_RATE}::DOUBLE / {TRAIT_RATE + NEUTRAL_RATE}::DOUBLE))', 'act')},
k AS (SELECT site, chr, bp, row_number() OVER (ORDER BY site) - 1 AS k FROM pl), p AS (SELECT k.*, act, mt.count AS trait, copies, {permuted_sql('k', 'n', 17, 'active')} AS place FROM k, so, mt, cp)
SELECT site AS slot, chr, bp, place < act AS active, place < trait AS is_qtl, {c._r(f"CASE WHEN place < trait THEN {_EFFECT(17, 'site')} ELSE 0 END")} AS alpha,
{c._r(f"CASE WHEN place < act THEN exp(-ln(copies) + {_q('=17', '=w', 'site')} * ln(copies - 1)) ELSE 0 END")} AS p FROM p""",
)


def _recap(s: SparkSession, d: str) -> DataFrame:
    sites = c._sites(s, d).withColumnRenamed("site", "slot")
    return state.written(mutation.recap_sites(sites, sites.count() // 3, "exponential", SCALE, 21, True), "recap")


def recap_genotypes(s: SparkSession, d: str) -> DataFrame:
    """A third of the suppliers' sites as active trait sites, placed on the genealogy: the samples that carry each one at first."""
    slots, e = _recap(s, d), state.written_by(views.edges(s, d), "edges", "gen")
    active = slots.where("active").select(F.col("slot").alias("site"), "chr", "bp")
    chosen = ancestry.branch_choice(ancestry.covering_edges(active, e), uniform(2, "branch", F.col("site")), F.col("gen"))
    begun = state.written(chosen.select("gen", "site", "chr", F.col("child").alias("node"), "bp"), "branches")
    samples = views.table(s, d, "part").select(F.col("p_partkey").alias("node"))
    carried = ancestry.carry_down(begun, e, ["site", "bp"], _generations(e), state.written, samples)
    per = carried.groupBy(F.col("site").alias("slot")).agg(F.count(F.lit(1)).alias("carriers"), F.sum("node").alias("nodes"))
    return c._rounded(slots.join(per, "slot", "left").select("slot", "chr", "bp", "is_qtl", "active", "alpha", F.coalesce("carriers", F.lit(0)).alias("carriers"), F.coalesce("nodes", F.lit(0)).alias("nodes")), "alpha")


register(
    "recap_genotypes",
    recap_genotypes,
    f"""WITH {c._EDGES}, {c._SITES}, k AS (SELECT *, row_number() OVER (ORDER BY site) - 1 AS k, count(*) OVER () AS n FROM sup), q AS (SELECT site, chr, bp, {permuted_sql('k', 'n', 21, 'recap')} < n // 3 AS is_qtl FROM k),
cv AS (SELECT site, q.chr, bp, e.gen, e.parent, e.child FROM q JOIN edges e ON e.chr = q.chr AND bp >= e.left AND bp < e.right WHERE is_qtl),
rn AS (SELECT *, sum(gen) OVER (PARTITION BY site ORDER BY gen, parent, child ROWS UNBOUNDED PRECEDING) AS cum, sum(gen) OVER (PARTITION BY site) AS total FROM cv),
kk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY cum, gen, parent, child) AS r FROM rn WHERE cum >= {_q('=2', '=branch', 'site')} * total),
m AS (SELECT gen, site, chr, child AS node, bp FROM kk WHERE r = 1), {_descent_sql('m', 'site, ')}, ca AS (SELECT site, count(*) AS carriers, sum(node)::BIGINT AS nodes FROM h7 WHERE node IN (SELECT p_partkey FROM part) GROUP BY site)
SELECT site AS slot, chr, bp, is_qtl, is_qtl AS active, {c._r(f"CASE WHEN is_qtl THEN {_EFFECT(21, 'site')} ELSE 0 END")} AS alpha, coalesce(carriers, 0) AS carriers, coalesce(nodes, 0) AS nodes FROM q LEFT JOIN ca USING (site)""",
)


def edges_at_variants(s: SparkSession, d: str) -> DataFrame:
    """The stretches of each individual's gamete, cut at the variants where its crossovers take effect."""
    people, variants = views.haplotypes(s, d).select(F.col("ind_id").alias("gamete")).distinct(), views.variants(s, d)
    cut = reproduction.edges_at_variants(people, variants, c._points(s, d), views.CHR_LEN, 5)
    return cut.withColumn("parent", 2 * F.col("gamete") + F.col("strand"))


register(
    "edges_at_variants",
    edges_at_variants,
    f"""WITH {c.V}, {c._POINTS}, af AS (SELECT gamete, chr, (SELECT min(v.bp) FROM variants v WHERE v.chr = pts.chr AND v.bp >= pts.bp) AS bp FROM pts),
e AS (SELECT gamete, chr, bp, count(*) AS n FROM af WHERE bp IS NOT NULL GROUP BY ALL UNION ALL SELECT gamete, chr, 1, 0 FROM gc),
g AS (SELECT gamete, chr, bp, sum(n) AS n FROM e GROUP BY gamete, chr, bp), w AS (SELECT gamete, chr, bp AS a, lead(bp, 1, 100001) OVER o AS z, sum(n) OVER o AS turns FROM g WINDOW o AS (PARTITION BY gamete, chr ORDER BY bp)),
st AS (SELECT gamete, chr, a::INTEGER AS "left", z::INTEGER AS "right", ((floor({_q('=5', '=start', 'gamete', 'chr')} * 2) + turns) % 2)::INTEGER AS strand FROM w)
SELECT *, (2 * gamete + strand)::BIGINT AS parent FROM st""",
)


def merged_panel(s: SparkSession, d: str) -> DataFrame:
    """Trait sites of the stored haplotypes and neutral sites of the genealogy whose children are haplotypes, as one bundle.

    Read back site by site: name, effect, copies and heterozygotes. Neutral sites that no haplotype carries are not there.
    """
    hap, variants = c._genotypes(s, d)
    people = state.written(hap.groupBy("ind_id").agg(F.lit(1).alias("deme"), F.lit(0.0).alias("a")), "people")
    carriers = hap.where("allele = 1").select("slot", "hap_id")
    neutral = views.edges(s, d).select("chr", F.col("left").cast("int").alias("bp"), F.col("child").alias("hap_id")).join(hap.select("hap_id").distinct(), "hap_id", "left_semi")
    active = variants.join(carriers.select("slot").distinct(), "slot", "left_semi")
    path = state.new_folder(s, "merged")
    bundle.write_merged(path, active, carriers, neutral, people, lambda h: F.floor(h / 2), 1e-8, state.written, compressed=True)
    counts = bundle.read_genotypes(s, path, people.count()).groupBy("row").agg(F.sum("g").alias("copies"), F.count_if(F.col("g") == 1).alias("hets"))
    sites = bundle.read_effects(s, path).withColumnRenamed("place", "row").join(counts, "row", "left")
    return c._rounded(sites.select("row", "snp_id", "chr", "bp", "is_qtl", "alpha", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("copies", "hets")]), "alpha")


register(
    "merged_panel",
    merged_panel,
    f"""WITH {c.V}, {c._EDGES}, ne AS (SELECT DISTINCT chr, "left"::INTEGER AS bp, child AS hap_id FROM edges WHERE child IN (SELECT hap_id FROM hap)),
ce AS (SELECT v.chr, v.bp, 0 AS kind, v.slot::BIGINT AS slot, alpha, hap_id FROM hap JOIN variants v USING (slot) WHERE allele = 1 AND is_qtl UNION ALL SELECT chr, bp, 1, 0, 0.0, hap_id FROM ne),
gi AS (SELECT chr, bp, kind, slot, any_value(alpha) AS alpha, hap_id // 2 AS ind_id, count(*) AS g FROM ce GROUP BY chr, bp, kind, slot, hap_id // 2),
si AS (SELECT chr, bp, kind, slot, any_value(alpha) AS alpha, sum(g)::BIGINT AS copies, count(*) FILTER (g = 1) AS hets FROM gi GROUP BY chr, bp, kind, slot)
SELECT row_number() OVER (ORDER BY chr, bp, kind, slot) - 1 AS row, 'chr' || chr || '_' || bp || CASE kind WHEN 0 THEN '_q' ELSE '_n' END AS snp_id, chr, bp, kind = 0 AS is_qtl, {c._r('alpha')} AS alpha, copies, hets FROM si""",
)


def loaded_bundle(s: SparkSession, d: str) -> DataFrame:
    """Customers and parts written as a bundle and loaded as a population on a grid of nations: value and load by deme."""
    got = bundle.load_bundle(s, _bundle(s, d)[0], 29, grid=True)
    cells = got.carriers.join(got.sites.select(F.col("place").alias("row"), "alpha", "is_qtl"), "row").groupBy(F.col("col").alias("place")).agg(F.count(F.lit(1)).alias("copies"), F.count_if(F.col("copy") == 0).alias("first"), F.sum("alpha").alias("value"))
    per = got.people.join(cells, "place", "left").groupBy("deme").agg(F.count(F.lit(1)).alias("people"), F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"), F.coalesce(F.sum("first"), F.lit(0)).alias("first"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    return c._rounded(per.withColumn("grid", F.lit(got.grid)), "value")


register(
    "loaded_bundle",
    loaded_bundle,
    f"""WITH {c._GENO2}, pl AS (SELECT *, row_number() OVER (ORDER BY chr, bp, slot) - 1 AS row FROM parts),
pe AS (SELECT c_custkey AS ind_id, c_nationkey AS deme, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS col FROM customer),
gr AS (SELECT CASE WHEN floor(sqrt(count(DISTINCT deme)))::INTEGER ** 2 = count(DISTINCT deme) THEN floor(sqrt(count(DISTINCT deme)))::INTEGER ELSE 1 END AS grid FROM pe),
ce AS (SELECT ind_id, g, alpha, g = 2 OR {_q('=29', '=phase', 'row', 'col')} < 0.5 AS first FROM geno2 JOIN pl USING (slot) JOIN pe USING (ind_id)),
pi AS (SELECT ind_id, sum(g) AS copies, count(*) FILTER (first) AS first, sum(g * alpha) AS value FROM ce GROUP BY ind_id)
SELECT CASE WHEN grid > 1 THEN deme ELSE 1 END::INTEGER AS deme, count(*) AS people, coalesce(sum(copies), 0)::BIGINT AS copies, coalesce(sum(first), 0)::BIGINT AS first, {c._r('coalesce(sum(value), 0)')} AS value, any_value(grid)::INTEGER AS grid
FROM pe LEFT JOIN pi USING (ind_id), gr GROUP BY 1""",
)
