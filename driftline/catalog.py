"""Registers the library's queries over the stored tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import genetics
from driftline.functions.rng import exponential, normal, poisson, sign, uniform, uniform_sql
from driftline.operators import ancestry, ld, reproduction, selection, spatial, stats
from driftline.plans import generations
from driftline.registry import register
from driftline.sources import plink, state, views
from driftline.streaming import monitor

V = views.SQL


def _genotypes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return views.haplotypes(spark, d), views.variants(spark, d)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six decimals; sums have no order. Minus zero becomes zero."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def _r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


# --- statistics -------------------------------------------------------------------------------------------------

register(
    "allele_freq",
    lambda s, d: _rounded(stats.allele_frequency(*_genotypes(s, d)), "p"),
    f"WITH {V} SELECT slot::INTEGER AS slot, {_r('p')} AS p FROM freq",
)
register(
    "breeding_value",
    lambda s, d: _rounded(stats.breeding_values(*_genotypes(s, d)), "a"),
    f"WITH {V} SELECT ind_id, deme, {_r('a')} AS a FROM bv",
)
register(
    "genic_variance",
    lambda s, d: _rounded(stats.genic_variance(*_genotypes(s, d)), "genic"),
    f"WITH {V} SELECT {_r('sum(2 * p * (1 - p) * alpha * alpha)')} AS genic FROM freq JOIN variants USING (slot) WHERE is_qtl",
)
_DEME = f"""WITH {V}, dp AS (SELECT deme, slot, avg(allele) AS p FROM hap GROUP BY ALL),
dg AS (SELECT deme, sum(2 * p * (1 - p) * alpha * alpha) AS genic FROM dp JOIN variants USING (slot) WHERE is_qtl GROUP BY deme),
dv AS (SELECT deme, count(*) AS n, coalesce(var_samp(a), 0) AS va FROM bv GROUP BY deme)"""
register(
    "bulmer_per_deme",
    lambda s, d: _rounded(stats.bulmer_per_deme(*_genotypes(s, d)), "va", "genic", "b"),
    f"{_DEME} SELECT deme, n, {_r('va')} AS va, {_r('genic')} AS genic, {_r('CASE WHEN genic = 0 THEN 0 ELSE (va - genic) / genic END')} AS b FROM dv JOIN dg USING (deme)",
)
register(
    "bulmer_deme_average",
    lambda s, d: _rounded(stats.bulmer_per_deme(*_genotypes(s, d)).agg(F.avg("b").alias("b"), F.avg("va").alias("va")), "b", "va"),
    f"{_DEME} SELECT {_r('avg(CASE WHEN genic = 0 THEN 0 ELSE (va - genic) / genic END)')} AS b, {_r('avg(va)')} AS va FROM dv JOIN dg USING (deme)",
)


def bulmer_pooled(s: SparkSession, d: str) -> DataFrame:
    hap, variants = _genotypes(s, d)
    va = stats.mean_and_variance(stats.breeding_values(hap, variants)).select("n", F.col("variance").alias("va"))
    return _rounded(va.crossJoin(F.broadcast(stats.genic_variance(hap, variants))).withColumn("b", genetics.bulmer(F.col("va"), F.col("genic"))), "va", "genic", "b")  # one row each


register(
    "bulmer_pooled",
    bulmer_pooled,
    f"""WITH {V}, g AS (SELECT sum(2 * p * (1 - p) * alpha * alpha) AS genic FROM freq JOIN variants USING (slot) WHERE is_qtl),
v AS (SELECT count(*) AS n, var_samp(a) AS va FROM bv) SELECT n, {_r('va')} AS va, {_r('genic')} AS genic, {_r('(va - genic) / genic')} AS b FROM v, g""",
)
register(
    "polymorphic_count",
    lambda s, d: stats.polymorphic_count(stats.allele_frequency(*_genotypes(s, d))),
    f"WITH {V} SELECT count(*) FILTER (WHERE p > 1e-12 AND p < 1 - 1e-12) AS n_polymorphic FROM freq",
)
register(
    "fst",
    lambda s, d: _rounded(stats.fst(views.haplotypes(s, d)), "fst"),
    f"WITH {V}, dp AS (SELECT deme, slot, avg(allele) AS p FROM hap GROUP BY ALL), site AS (SELECT slot, var_pop(p) AS v, avg(p) AS m FROM dp GROUP BY slot) SELECT {_r('sum(v) / sum(m * (1 - m))')} AS fst FROM site",
)
_GENO2 = """geno2 AS (SELECT o_custkey AS ind_id, c_nationkey AS deme, l_partkey + 1 AS slot, least(count(*), 2)::INTEGER AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
keys AS (SELECT p_partkey + 1 AS slot FROM part),
parts AS (SELECT slot, (1 + floor((slot - 1) / ceil((SELECT max(slot) FROM keys) / 4.0)))::INTEGER AS chr, (1 + (slot * 7919) % 100000)::INTEGER AS bp,
  (CASE WHEN (slot * 104729) % 2001 = 1000 THEN 0.0001 ELSE ((slot * 104729) % 2001 - 1000) / 10000.0::DOUBLE END)::DOUBLE AS alpha, slot % 8 <> 0 AS is_qtl FROM keys)"""


def sparse_breeding_value(s: SparkSession, d: str, cells: DataFrame | None = None) -> DataFrame:
    """Breeding values over sparse dosages, those of the tables or `cells`: individuals without a trait allele have 0."""
    people = views.table(s, d, "customer").select(F.col("c_custkey").alias("ind_id"), F.col("c_nationkey").alias("deme"))
    effects = views.part_variants(s, d).where("is_qtl").select("slot", "alpha")
    own = (views.dosages(s, d) if cells is None else cells).join(effects, "slot").groupBy("ind_id").agg(F.sum(F.col("g") * F.col("alpha")).alias("a"))
    return _rounded(people.join(own, "ind_id", "left").withColumn("a", F.coalesce("a", F.lit(0.0))), "a")


register(
    "sparse_breeding_value",
    sparse_breeding_value,
    f"WITH {_GENO2}, own AS (SELECT ind_id, sum(g * alpha) AS a FROM geno2 JOIN parts USING (slot) WHERE is_qtl GROUP BY ind_id) SELECT c_custkey AS ind_id, c_nationkey AS deme, {_r('coalesce(a, 0)')} AS a FROM customer LEFT JOIN own ON ind_id = c_custkey",
)


def sparse_frequency(s: SparkSession, d: str) -> DataFrame:
    """Frequencies of all parts over all customers, 0 where no one has the part."""
    copies = views.dosages(s, d).groupBy("slot").agg(F.sum("g").alias("_c"))
    n = views.table(s, d, "customer").agg(F.count(F.lit(1)).alias("_n"))
    joined = views.part_variants(s, d).select("slot").join(copies, "slot", "left").crossJoin(F.broadcast(n))  # one row
    return _rounded(joined.select("slot", (F.coalesce("_c", F.lit(0)) / (2 * F.col("_n"))).alias("p")), "p")


register(
    "sparse_frequency",
    sparse_frequency,
    f"WITH {_GENO2} SELECT p.slot, {_r('coalesce(sum(g), 0)::DOUBLE / (2 * (SELECT count(*) FROM customer))')} AS p FROM parts p LEFT JOIN geno2 USING (slot) GROUP BY p.slot",
)
register(
    "chr_ranges",
    lambda s, d: views.part_variants(s, d).groupBy("chr").agg(F.min("slot").alias("first"), F.max("slot").alias("last"), F.count_if("is_qtl").alias("n_qtl")),
    f"WITH {_GENO2} SELECT chr, min(slot) AS first, max(slot) AS last, count(*) FILTER (WHERE is_qtl) AS n_qtl FROM parts GROUP BY chr",
)
register(
    "convergence_tail",
    lambda s, d: _rounded(stats.convergence(views.trajectory(s, d), ["run"]), "tail_mean", "tail_sd", "half_change"),
    f"""WITH t AS (SELECT user_id AS run, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
w AS (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM t WHERE k <= 20),
a AS (SELECT run, avg(value) FILTER (WHERE k <= 10) AS tail_mean, stddev_samp(value) FILTER (WHERE k <= 10) AS tail_sd, max(n) AS n,
  avg(value) FILTER (WHERE k <= n // 2) AS new, avg(value) FILTER (WHERE k > n // 2) AS old FROM w GROUP BY run)
SELECT run, {_r('tail_mean')} AS tail_mean, {_r('tail_sd')} AS tail_sd, {_r('CASE WHEN n >= 4 AND old <> 0 THEN (new - old) / abs(old) END')} AS half_change FROM a""",
)

# --- linkage disequilibrium --------------------------------------------------------------------------------------


def _ld(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    hap, variants = _genotypes(s, d)
    return stats.dosage(hap), ld.trait_sites(hap, variants)


register(
    "scope_pairs",
    lambda s, d: ld.scope_pairs(_ld(s, d)[1]).groupBy("chr").agg(F.count(F.lit(1)).alias("within"), F.count_if("in_window").alias("in_window")),
    f"WITH {V} SELECT a.chr, count(*) AS within, count(*) FILTER (WHERE abs(a.bp - b.bp) <= 25000) AS in_window FROM qtl a JOIN qtl b ON a.chr = b.chr AND a.slot <> b.slot GROUP BY a.chr",
)


def ld_covariance(s: SparkSession, d: str) -> DataFrame:
    geno, sites = _ld(s, d)
    return _rounded(ld.covariances(geno, sites, views.CHR_LEN / 4, state.written), "cov")


register(
    "ld_covariance",
    ld_covariance,
    f"""WITH {V}, pairs AS (SELECT a.slot AS j, b.slot AS k FROM qtl a JOIN qtl b ON a.chr = b.chr AND a.slot <> b.slot AND abs(a.bp - b.bp) <= 25000)
SELECT x.deme, j::INTEGER AS j, k::INTEGER AS k, {_r('covar_samp(x.g, y.g)')} AS cov FROM pairs JOIN geno x ON x.slot = j JOIN geno y ON y.slot = k AND y.ind_id = x.ind_id GROUP BY ALL""",
)
_VALUES = """cells AS (SELECT deme, ind_id, chr, slot, alpha, g FROM geno JOIN qtl USING (slot)),
diag AS (SELECT deme, sum(v) AS diagonal FROM (SELECT deme, slot, var_samp(g) * max(alpha * alpha) AS v FROM cells GROUP BY ALL) GROUP BY deme)"""
register(
    "bulmer_scope_b",
    lambda s, d: _rounded(ld.scope_b(ld.scope_values(*_ld(s, d))), "genome", "within"),
    f"""WITH {V}, {_VALUES}, part AS (SELECT deme, ind_id, chr, sum(alpha * g) AS a FROM cells GROUP BY ALL),
wi AS (SELECT deme, sum(v) AS by_chr FROM (SELECT deme, chr, var_samp(a) AS v FROM part GROUP BY ALL) GROUP BY deme),
wh AS (SELECT deme, count(*) AS n, var_samp(a) AS whole FROM (SELECT deme, ind_id, sum(a) AS a FROM part GROUP BY ALL) GROUP BY deme)
SELECT {_r('sum(n * (whole - diagonal)) / sum(n * diagonal)')} AS genome, {_r('sum(n * (by_chr - diagonal)) / sum(n * diagonal)')} AS within FROM wh JOIN wi USING (deme) JOIN diag USING (deme) WHERE n >= 3""",
)
N_PERM = 20
_SIGNS = f"signs AS (SELECT slot, perm, CASE WHEN {uniform_sql('1', 'slot', 'perm')} < 0.5 THEN 1 ELSE -1 END AS sign FROM qtl, range(1, {N_PERM + 1}) t(perm))"
_NULL = f"""{_VALUES}, {_SIGNS},
part AS (SELECT perm, deme, ind_id, chr, sum(alpha * sign * g) AS a FROM cells JOIN signs USING (slot) GROUP BY ALL),
wi AS (SELECT perm, deme, sum(v) AS by_chr FROM (SELECT perm, deme, chr, var_samp(a) AS v FROM part GROUP BY ALL) GROUP BY ALL),
wh AS (SELECT perm, deme, count(*) AS n, var_samp(a) AS whole FROM (SELECT perm, deme, ind_id, sum(a) AS a FROM part GROUP BY ALL) GROUP BY ALL),
nul AS (SELECT perm, sum(n * (whole - diagonal)) / sum(n * diagonal) AS genome, sum(n * (by_chr - diagonal)) / sum(n * diagonal) AS within FROM wh JOIN wi USING (perm, deme) JOIN diag USING (deme) WHERE n >= 3 GROUP BY perm)"""


def _null_b(s: SparkSession, d: str) -> DataFrame:
    points = selection.sign_flip_points(*_ld(s, d), (), views.CHR_LEN, N_PERM).where("perm > 0")
    of = lambda scope: F.max(F.when(F.col("scope") == scope, F.col("b"))).alias(scope)
    return points.groupBy("perm").agg(of("genome"), of("within"))


register("signflip_null_b", lambda s, d: _rounded(_null_b(s, d), "genome", "within"), f"WITH {V}, {_NULL} SELECT perm::INTEGER AS perm, {_r('genome')} AS genome, {_r('within')} AS within FROM nul")


def signflip_p(s: SparkSession, d: str) -> DataFrame:
    geno, sites = _ld(s, d)
    observed, null = ld.scope_b(ld.scope_values(geno, sites)), _null_b(s, d)
    return _rounded(ld.one_sided(observed, null, "genome").union(ld.one_sided(observed, null, "within")), "b", "p")


_OBSERVED = """part0 AS (SELECT deme, ind_id, chr, sum(alpha * g) AS a FROM cells GROUP BY ALL),
wi0 AS (SELECT deme, sum(v) AS by_chr FROM (SELECT deme, chr, var_samp(a) AS v FROM part0 GROUP BY ALL) GROUP BY deme),
wh0 AS (SELECT deme, count(*) AS n, var_samp(a) AS whole FROM (SELECT deme, ind_id, sum(a) AS a FROM part0 GROUP BY ALL) GROUP BY deme),
obs AS (SELECT sum(n * (whole - diagonal)) / sum(n * diagonal) AS genome, sum(n * (by_chr - diagonal)) / sum(n * diagonal) AS within FROM wh0 JOIN wi0 USING (deme) JOIN diag USING (deme) WHERE n >= 3)"""
register(
    "signflip_p",
    signflip_p,
    f"""WITH {V}, {_NULL}, {_OBSERVED}
SELECT 'genome' AS scope, {_r('max(o.genome)')} AS b, count(*) AS n_perm, {_r('(1 + count(*) FILTER (WHERE n.genome <= o.genome))::DOUBLE / (1 + count(*))')} AS p FROM nul n, obs o
UNION ALL SELECT 'within', {_r('max(o.within)')}, count(*), {_r('(1 + count(*) FILTER (WHERE n.within <= o.within))::DOUBLE / (1 + count(*))')} FROM nul n, obs o""",
)
_MARGINAL = """whole AS (SELECT deme, ind_id, sum(alpha * g) AS a FROM cells GROUP BY ALL),
each AS (SELECT deme, slot, count(*) AS n, max(alpha) AS alpha, covar_samp(g, a) AS c, var_samp(g) AS v FROM cells JOIN whole USING (deme, ind_id) GROUP BY ALL),
marg AS (SELECT slot, sum(n * alpha * (c - alpha * v)) / sum(n) AS b FROM each WHERE n >= 3 GROUP BY slot)"""
register("marginal_b", lambda s, d: _rounded(ld.marginal_b(*_ld(s, d)), "b"), f"WITH {V}, {_VALUES}, {_MARGINAL} SELECT slot::INTEGER AS slot, {_r('b')} AS b FROM marg")
register(
    "rho_pearson",
    lambda s, d: _rounded(ld.marginal_b(*_ld(s, d)).join(_ld(s, d)[1], "slot").agg(F.corr("b", ld.polarized(F.col("p"), F.col("alpha"))).alias("rho"), F.count(F.lit(1)).alias("n")), "rho"),
    f"WITH {V}, {_VALUES}, {_MARGINAL} SELECT {_r('corr(b, greatest(0.005, least(0.995, CASE WHEN alpha > 0 THEN p ELSE 1 - p END)))')} AS rho, count(*) AS n FROM marg JOIN qtl USING (slot)",
)
register(
    "dir_ap",
    lambda s, d: _rounded(ld.direction(_ld(s, d)[1], ld.permutation_signs(_ld(s, d)[1], N_PERM)), "value", "mean", "p"),
    f"""WITH {V}, {_SIGNS}, o AS (SELECT sum(alpha * p) AS value FROM qtl), x AS (SELECT perm, sum(sign * alpha * p) AS x FROM qtl JOIN signs USING (slot) GROUP BY perm),
m AS (SELECT avg(x) AS mean FROM x) SELECT {_r('max(value)')} AS value, {_r('max(mean)')} AS mean, {_r('(1 + count(*) FILTER (WHERE abs(x - mean) >= abs(value - mean)))::DOUBLE / (1 + count(*))')} AS p FROM x, m, o""",
)


def mahal_2d(s: SparkSession, d: str) -> DataFrame:
    """Distance of the observed (B, direction) from its sign-flip cloud."""
    geno, sites = _ld(s, d)
    signs = ld.permutation_signs(sites, N_PERM)
    x = sites.join(signs, "slot").groupBy("perm").agg(F.sum(F.col("sign") * F.col("alpha") * F.col("p")).alias("y"))
    points = _null_b(s, d).select("perm", F.col("genome").alias("x")).join(x, "perm").select("x", "y")
    observed = ld.scope_b(ld.scope_values(geno, sites)).select(F.col("genome").alias("x")).crossJoin(sites.agg(F.sum(F.col("alpha") * F.col("p")).alias("y")))
    return _rounded(ld.ellipse_test(points, observed), "distance", "p")


register(
    "mahal_2d",
    mahal_2d,
    f"""WITH {V}, {_NULL}, {_OBSERVED}, y AS (SELECT perm, sum(sign * alpha * p) AS y FROM qtl JOIN signs USING (slot) GROUP BY perm),
pts AS (SELECT genome AS x, y FROM nul JOIN y USING (perm)),
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) + 1e-8 * (var_samp(x) + var_samp(y)) AS sxx, var_samp(y) + 1e-8 * (var_samp(x) + var_samp(y)) AS syy, covar_samp(x, y) AS sxy FROM pts),
o AS (SELECT genome AS ox, (SELECT sum(alpha * p) FROM qtl) AS oy FROM obs),
e AS (SELECT (syy * (x - mx) ** 2 - 2 * sxy * (x - mx) * (y - my) + sxx * (y - my) ** 2) / (sxx * syy - sxy * sxy) AS d,
  (syy * (ox - mx) ** 2 - 2 * sxy * (ox - mx) * (oy - my) + sxx * (oy - my) ** 2) / (sxx * syy - sxy * sxy) AS o FROM pts, m, o)
SELECT {_r('sqrt(max(o))')} AS distance, {_r('(1 + count(*) FILTER (WHERE d >= o))::DOUBLE / (1 + count(*))')} AS p FROM e""",
)

# --- space, fitness and parents ----------------------------------------------------------------------------------

GRID = 5


def _nations(s: SparkSession, d: str) -> DataFrame:
    """The nations as demes of a 5 x 5 grid, numbered from 1."""
    return views.table(s, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("deme"))


_NEAR = f"""near AS (SELECT a.deme, b.deme AS neighbour, 1 - 0.05::DOUBLE * count(*) OVER (PARTITION BY a.deme) AS prob_stay
FROM (SELECT n_nationkey + 1 AS deme FROM nation) a JOIN (SELECT n_nationkey + 1 AS deme FROM nation) b
ON abs((a.deme - 1) % {GRID} - (b.deme - 1) % {GRID}) + abs((a.deme - 1) // {GRID} - (b.deme - 1) // {GRID}) = 1)"""
register(
    "grid_neighbours",
    lambda s, d: _rounded(spatial.grid_neighbours(_nations(s, d), GRID, 0.05), "prob_stay"),
    f"WITH {_NEAR} SELECT deme::BIGINT AS deme, neighbour::BIGINT AS neighbour, {_r('prob_stay')} AS prob_stay FROM near",
)
register(
    "cline",
    lambda s, d: _rounded(_nations(s, d).select("deme", spatial.cline_offset(F.col("deme"), GRID, 2.0, 1.5).alias("theta")), "theta"),
    f"SELECT (n_nationkey + 1)::BIGINT AS deme, {_r(f'2.0 * 1.5 * (n_nationkey // {GRID} - 2) / 2.0')} AS theta FROM nation",
)


def _fitness(s: SparkSession, d: str) -> DataFrame:
    hap, variants = _genotypes(s, d)
    return stats.breeding_values(hap, variants).withColumn("w", genetics.gaussian_fitness(F.col("a"), 0.1 * F.col("deme"), F.lit(0.5)))


_W = "fit AS (SELECT ind_id, deme, a, exp(-((a - 0.1 * deme) ** 2) / (2 * 0.5)) AS w FROM bv)"
register("fitness", lambda s, d: _rounded(_fitness(s, d), "a", "w"), f"WITH {V}, {_W} SELECT ind_id, deme, {_r('a')} AS a, {_r('w')} AS w FROM fit")
register(
    "cumulative_fitness",
    lambda s, d: _rounded(spatial.cumulative(_fitness(s, d)), "cum").select("deme", "ind_id", "cum"),
    f"WITH {V}, {_W} SELECT deme, ind_id, {_r('sum(w) OVER (PARTITION BY deme ORDER BY ind_id)')} AS cum FROM fit",
)


def weighted_parent(s: SparkSession, d: str) -> DataFrame:
    fit = _fitness(s, d)
    draws = fit.select("deme", F.col("ind_id").alias("draw"), uniform(1, "parent", F.col("ind_id")).alias("u"))
    return spatial.weighted_parent(draws, fit)


register(
    "weighted_parent",
    weighted_parent,
    f"""WITH {V}, {_W}, c AS (SELECT deme, ind_id, sum(w) OVER (PARTITION BY deme ORDER BY ind_id) AS cum, sum(w) OVER (PARTITION BY deme) AS total FROM fit),
dr AS (SELECT deme, ind_id AS draw, {uniform_sql("'1'", "'parent'", 'ind_id')} AS u FROM fit)
SELECT dr.deme, draw, min(c.ind_id) AS parent FROM dr JOIN c ON c.deme = dr.deme AND c.cum >= dr.u * c.total GROUP BY dr.deme, draw""",
)


def source_deme(s: SparkSession, d: str) -> DataFrame:
    draws = views.table(s, d, "customer").select((F.col("c_nationkey") + 1).cast("long").alias("deme"), F.col("c_custkey").alias("draw"))
    near = spatial.grid_neighbours(_nations(s, d), GRID, 0.05)
    return spatial.source_deme(draws, near, uniform(1, "stay", F.col("draw")), uniform(1, "pick", F.col("draw"))).select("draw", "deme", "source")


register(
    "source_deme",
    source_deme,
    f"""WITH {_NEAR}, l AS (SELECT deme, list(neighbour ORDER BY neighbour) AS near, max(prob_stay) AS stay FROM near GROUP BY deme),
u AS (SELECT c_custkey AS draw, c_nationkey + 1 AS deme, {uniform_sql("'1'", "'stay'", 'c_custkey')} AS us, {uniform_sql("'1'", "'pick'", 'c_custkey')} AS up FROM customer)
SELECT draw, u.deme::BIGINT AS deme, (CASE WHEN us < stay THEN u.deme ELSE near[1 + floor(up * len(near))::INTEGER] END)::BIGINT AS source FROM u JOIN l ON l.deme = u.deme""",
)
register(
    "phenotype_variance",
    lambda s, d: _rounded(
        stats.mean_and_variance(
            stats.breeding_values(*_genotypes(s, d)).withColumn("z", F.col("a") + normal(uniform(1, "e1", F.col("ind_id")), uniform(1, "e2", F.col("ind_id")), 0.3)), ["deme"], "z"
        ), "mean", "variance",
    ),
    f"""WITH {V}, z AS (SELECT deme, a + sqrt(-2 * ln({uniform_sql("'1'", "'e1'", 'ind_id')})) * cos(2 * pi() * {uniform_sql("'1'", "'e2'", 'ind_id')}) * 0.3 AS z FROM bv)
SELECT deme, count(*) AS n, {_r('avg(z)')} AS mean, {_r('coalesce(var_samp(z), 0)')} AS variance FROM z GROUP BY deme""",
)

# --- initial state -----------------------------------------------------------------------------------------------

register(
    "rng_uniform",
    lambda s, d: _rounded(views.table(s, d, "orders").select("o_orderkey", uniform(7, "o", F.col("o_orderkey")).alias("u")), "u"),
    f"SELECT o_orderkey, {_r(uniform_sql(chr(39) + '7' + chr(39), chr(39) + 'o' + chr(39), 'o_orderkey'))} AS u FROM orders",
)
register(
    "effects",
    lambda s, d: _rounded(
        views.table(s, d, "part").select(F.col("p_partkey").alias("slot"), (sign(1, "s", F.col("p_partkey")) * exponential(uniform(1, "a", F.col("p_partkey")), 0.03)).alias("alpha")), "alpha"
    ),
    f"""SELECT p_partkey AS slot, {_r(f"(CASE WHEN {uniform_sql(chr(39) + '1' + chr(39), chr(39) + 's' + chr(39), 'p_partkey')} < 0.5 THEN 1 ELSE -1 END) * (-ln({uniform_sql(chr(39) + '1' + chr(39), chr(39) + 'a' + chr(39), 'p_partkey')}) * 0.03)")} AS alpha FROM part""",
)
register(
    "watterson_freq",
    lambda s, d: _rounded(
        views.table(s, d, "part").crossJoin(F.broadcast(views.table(s, d, "customer").agg((2.0 * F.count(F.lit(1))).alias("copies")))).select(F.col("p_partkey").alias("slot"), genetics.watterson_frequency(uniform(1, "w", F.col("p_partkey")), F.col("copies")).alias("p")), "p"
    ),
    f"""WITH c AS (SELECT 2.0 * count(*) AS copies FROM customer) SELECT p_partkey AS slot, {_r(f"exp(-ln(copies) + {uniform_sql(chr(39) + '1' + chr(39), chr(39) + 'w' + chr(39), 'p_partkey')} * ln(copies - 1))")} AS p FROM part, c""",
)
register(
    "harmonic_watterson",
    lambda s, d: _rounded(views.table(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).select("c_nationkey", "n", (4 * F.col("n") * 0.01 * genetics.harmonic_column(2 * F.col("n") - 1)).alias("segregating")), "segregating"),
    f"WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT c_nationkey, n, {_r('4 * n * 0.01 * (SELECT sum(1.0::DOUBLE / k) FROM range(1, 2 * n) t(k))')} AS segregating FROM c",
)


def founders(s: SparkSession, d: str) -> DataFrame:
    """Founder haplotypes drawn from the sites' frequencies: how many copies each site gets."""
    hap, variants = _genotypes(s, d)
    p = F.broadcast(stats.allele_frequency(hap, variants))
    drawn = hap.select("hap_id", "slot").join(p, "slot").where(uniform(3, F.col("hap_id"), F.col("slot")) < F.col("p"))
    return drawn.groupBy("slot").agg(F.count(F.lit(1)).alias("copies"))


register("founders", founders, f"WITH {V} SELECT slot::INTEGER AS slot, count(*) AS copies FROM hap JOIN freq USING (slot) WHERE {uniform_sql(chr(39) + '3' + chr(39), 'hap_id', 'slot')} < p GROUP BY slot")


def site_positions(s: SparkSession, d: str) -> DataFrame:
    """Parts placed on chromosomes by hash; those that share a position keep the lowest id; slots in order of position."""
    placed = views.table(s, d, "part").select(F.col("p_partkey").alias("site"), (1 + F.floor(uniform(1, "c", F.col("p_partkey")) * 4)).cast("int").alias("chr"), (1 + F.floor(uniform(1, "b", F.col("p_partkey")) * 20000)).cast("int").alias("bp"))
    kept = placed.groupBy("chr", "bp").agg(F.min("site").alias("site"))
    from pyspark.sql import Window

    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("chr").orderBy("bp")).cast("long"))


register(
    "site_positions",
    site_positions,
    f"""WITH p AS (SELECT p_partkey AS site, (1 + floor({uniform_sql("'1'", "'c'", 'p_partkey')} * 4))::INTEGER AS chr, (1 + floor({uniform_sql("'1'", "'b'", 'p_partkey')} * 20000))::INTEGER AS bp FROM part),
k AS (SELECT chr, bp, min(site) AS site FROM p GROUP BY ALL) SELECT chr, bp, site, row_number() OVER (PARTITION BY chr ORDER BY bp) AS rank FROM k""",
)

# --- meiosis and mutation ----------------------------------------------------------------------------------------


def _q(*key: str) -> str:
    """DuckDB text of a draw whose leading parts are literals written as =text."""
    return uniform_sql(*(f"'{k[1:]}'" if k.startswith("=") else k for k in key))



def _poisson_sql(u: str, mean: float, most: int = 64) -> str:
    """DuckDB text of `poisson`: the count of cumulated chances below u."""
    import math

    chance, total, steps = math.exp(-mean), 0.0, []
    for k in range(most):
        total += chance
        steps.append(repr(total))
        chance *= mean / (k + 1)
    return f"len(list_filter([{', '.join(s + '::DOUBLE' for s in steps)}], lambda s: {u} > s))"


def _points(s: SparkSession, d: str) -> DataFrame:
    people = views.haplotypes(s, d).select(F.col("ind_id").alias("gamete")).distinct()
    return reproduction.breakpoints(people, views.variants(s, d).select("chr").distinct(), 1.0, views.CHR_LEN, 5)


_POINTS = f"""gc AS (SELECT DISTINCT h.ind_id AS gamete, v.chr FROM (SELECT DISTINCT ind_id FROM hap) h, (SELECT DISTINCT chr FROM variants) v),
gk AS (SELECT gamete, chr, {_poisson_sql('u', 1.0)} AS k FROM (SELECT gamete, chr, {_q('=5', '=k', 'gamete', 'chr')} AS u FROM gc)),
pts AS (SELECT gamete, chr, (1 + floor({_q('=5', '=bp', 'gamete', 'chr', 'i')} * 100000))::INTEGER AS bp FROM (SELECT gamete, chr, unnest(range(1, k + 1)) AS i FROM gk))"""
register("breakpoints", _points, f"WITH {V}, {_POINTS} SELECT gamete, chr, bp FROM pts")
register(
    "breakpoints_asof",
    lambda s, d: reproduction.to_slots(_points(s, d), views.variants(s, d)),
    f"WITH {V}, {_POINTS} SELECT gamete, chr, bp, (SELECT arg_min(v.slot, v.bp) FROM variants v WHERE v.chr = pts.chr AND v.bp >= pts.bp)::BIGINT AS slot FROM pts",
)


def gamete(s: SparkSession, d: str) -> DataFrame:
    """One gamete of each individual: its breeding value and how many derived alleles it carries."""
    hap, variants = _genotypes(s, d)
    parents = hap.select(F.col("ind_id").alias("gamete"), "ind_id").distinct()
    made = reproduction.gametes(parents, hap, variants, _points(s, d), 5)
    return _rounded(made.join(F.broadcast(variants.select("slot", "alpha")), "slot").groupBy("gamete").agg(F.sum("allele").alias("derived"), F.sum(F.col("allele") * F.col("alpha")).alias("value")), "value")


register(
    "gamete",
    gamete,
    f"""WITH {V}, {_POINTS}, st AS (SELECT gamete, chr, slot, alpha,
  ((floor({_q('=5', '=start', 'gamete', 'chr')} * 2) + (SELECT count(*) FROM pts WHERE pts.gamete = gc.gamete AND pts.chr = gc.chr AND pts.bp <= v.bp)) % 2)::INTEGER AS strand FROM gc JOIN variants v USING (chr))
SELECT gamete, sum(allele)::BIGINT AS derived, {_r('sum(allele * alpha)')} AS value FROM st JOIN hap ON hap.ind_id = st.gamete AND hap.slot = st.slot AND hap.hap_id % 2 = st.strand GROUP BY gamete""",
)
def edge_segments(s: SparkSession, d: str) -> DataFrame:
    """The stretches of each individual's gamete, with the parent haplotype that each comes from."""
    people = views.haplotypes(s, d).select(F.col("ind_id").alias("gamete")).distinct()
    cut = reproduction.edge_segments(people, views.variants(s, d).select("chr").distinct(), _points(s, d), views.CHR_LEN, 5)
    return cut.withColumn("parent", 2 * F.col("gamete") + F.col("strand"))


register(
    "edge_segments",
    edge_segments,
    f"""WITH {V}, {_POINTS}, e AS (SELECT gamete, chr, bp FROM pts UNION ALL SELECT gamete, chr, 1 FROM gc),
n AS (SELECT gamete, chr, bp, row_number() OVER w AS i, lead(bp, 1, 100001) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY gamete, chr ORDER BY bp)),
st AS (SELECT gamete, chr, bp AS left, nxt AS right, ((floor({_q('=5', '=start', 'gamete', 'chr')} * 2) + i - 1) % 2)::INTEGER AS strand FROM n WHERE bp < nxt)
SELECT *, (2 * gamete + strand)::BIGINT AS parent FROM st""",
)


def xor_mutation(s: SparkSession, d: str) -> DataFrame:
    """Recurrent mutation over all cells: carriers of each site before and after."""
    hap = views.haplotypes(s, d)
    after = reproduction.flip(hap.where("allele = 1"), reproduction.mutated_cells(hap, 0.05, 9))
    return hap.groupBy("slot").agg(F.sum("allele").alias("before")).join(after.groupBy("slot").agg(F.count(F.lit(1)).alias("after")), "slot")


register(
    "xor_mutation",
    xor_mutation,
    f"WITH {V} SELECT slot::INTEGER AS slot, sum(allele)::BIGINT AS before, sum(CASE WHEN {_q('=9', '=mu', 'hap_id', 'slot')} < 0.05 THEN 1 - allele ELSE allele END)::BIGINT AS after FROM hap GROUP BY slot",
)


def _slots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return views.part_variants(s, d).select("slot", "chr"), views.dosages(s, d)


register(
    "ism_cleanup",
    lambda s, d: reproduction.cleanup(_slots(s, d)[0], _slots(s, d)[1].select(F.col("ind_id").alias("hap_id"), "slot"), 1500).groupBy("state").agg(F.count(F.lit(1)).alias("slots"), F.sum("carriers").alias("carriers")),
    f"""WITH {_GENO2}, c AS (SELECT p.slot, count(DISTINCT ind_id) AS n FROM parts p LEFT JOIN geno2 USING (slot) GROUP BY p.slot)
SELECT CASE WHEN n = 0 THEN 'lost' WHEN n >= 1500 THEN 'fixed' ELSE 'segregating' END AS state, count(*) AS slots, sum(n)::BIGINT AS carriers FROM c GROUP BY 1""",
)


def ism_free_slots(s: SparkSession, d: str) -> DataFrame:
    """Slots that are free while only customers of segment BUILDING in debt carry anything; 25 new mutations a chromosome."""
    slots, cells = _slots(s, d)
    some = views.table(s, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal < 0").select(F.col("c_custkey").alias("ind_id"))
    return reproduction.free_slots(slots, cells.join(some, "ind_id", "left_semi"), slots.select("chr").distinct().withColumn("n", F.lit(25))).withColumn("mutation", F.col("mutation").cast("long"))


register(
    "ism_free_slots",
    ism_free_slots,
    f"""WITH {_GENO2}, act AS (SELECT DISTINCT slot FROM geno2 JOIN customer ON c_custkey = ind_id WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0),
f AS (SELECT chr, slot, row_number() OVER (PARTITION BY chr ORDER BY slot) AS mutation FROM parts WHERE slot NOT IN (SELECT slot FROM act)) SELECT chr, slot, mutation FROM f WHERE mutation <= 25""",
)

# --- genealogies -------------------------------------------------------------------------------------------------

_EDGES = "edges AS (SELECT l_linenumber AS gen, (1 + l_suppkey % 4)::INTEGER AS chr, l_orderkey AS parent, l_partkey AS child, l_partkey AS left, l_partkey + l_quantity::BIGINT AS right FROM lineitem)"


def _sites(s: SparkSession, d: str) -> DataFrame:
    """A site for each supplier, on its chromosome."""
    return views.table(s, d, "supplier").select(F.col("s_suppkey").alias("site"), (1 + F.col("s_suppkey") % 4).cast("int").alias("chr"), (1 + (F.col("s_suppkey") * 37) % 1500).cast("long").alias("bp"))


_SITES = "sup AS (SELECT s_suppkey AS site, (1 + s_suppkey % 4)::INTEGER AS chr, (1 + (s_suppkey * 37) % 1500)::BIGINT AS bp FROM supplier)"
register(
    "interval_place",
    lambda s, d: ancestry.covering_edges(_sites(s, d), views.edges(s, d)).groupBy("site").agg(F.count(F.lit(1)).alias("edges"), F.min("parent").alias("first_parent")),
    f"WITH {_EDGES}, {_SITES} SELECT site, count(*) AS edges, min(parent) AS first_parent FROM sup JOIN edges e ON e.chr = sup.chr AND bp >= e.left AND bp < e.right GROUP BY site",
)


def branch_weight_choice(s: SparkSession, d: str) -> DataFrame:
    near = ancestry.covering_edges(_sites(s, d), views.edges(s, d))
    return ancestry.branch_choice(near, uniform(2, "branch", F.col("site")), F.col("gen")).select("site", "gen", "parent", "child")


register(
    "branch_weight_choice",
    branch_weight_choice,
    f"""WITH {_EDGES}, {_SITES}, c AS (SELECT site, e.gen, e.parent, e.child FROM sup JOIN edges e ON e.chr = sup.chr AND bp >= e.left AND bp < e.right),
r AS (SELECT *, sum(gen) OVER (PARTITION BY site ORDER BY gen, parent, child ROWS UNBOUNDED PRECEDING) AS cum, sum(gen) OVER (PARTITION BY site) AS total FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY cum, gen, parent, child) AS k FROM r WHERE cum >= {_q('=2', '=branch', 'site')} * total)
SELECT site, gen, parent, child FROM k WHERE k = 1""",
)


def simplify_reachability(s: SparkSession, d: str) -> DataFrame:
    """Edges above the small parts, generation by generation; counted by generation and chromosome."""
    made = state.written_by(views.edges(s, d), "edges", "gen")
    samples = views.table(s, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("node")).crossJoin(F.broadcast(made.select("chr").distinct()))  # a row a chromosome
    generations = [r["gen"] for r in made.select("gen").distinct().orderBy(F.desc("gen")).collect()]  # line numbers: at most seven
    kept = ancestry.simplify(made, samples, generations, state.written)
    return kept.groupBy("gen", "chr").agg(F.count(F.lit(1)).alias("edges"))


def _simplify_sql() -> str:
    steps = ["a8 AS (SELECT chr, p_partkey AS node FROM part, (SELECT DISTINCT chr FROM edges) WHERE p_size <= 10)"]
    for g in range(7, 0, -1):
        steps.append(f"k{g} AS (SELECT e.* FROM edges e WHERE gen = {g} AND EXISTS (SELECT 1 FROM a{g + 1} a WHERE a.chr = e.chr AND a.node = e.child))")
        steps.append(f"a{g} AS (SELECT * FROM a{g + 1} UNION SELECT chr, parent FROM k{g})")
    every = " UNION ALL ".join(f"SELECT * FROM k{g}" for g in range(1, 8))
    return f"WITH {_EDGES}, {', '.join(steps)} SELECT gen, chr, count(*) AS edges FROM ({every}) GROUP BY gen, chr"


register("simplify_reachability", simplify_reachability, _simplify_sql())


def overlay_propagate(s: SparkSession, d: str) -> DataFrame:
    """Neutral mutations on all edges, and how many reach a child's child over a covering edge."""
    e = views.edges(s, d)
    key = [F.col(c) for c in ("gen", "chr", "parent", "child", "left")]
    made = ancestry.overlay_mutations(e, poisson(uniform(4, "m", *key), 0.5), F.col("left") + F.floor(uniform(4, "p", *key, F.col("i")) * (F.col("right") - F.col("left"))))
    nodes = state.written(made.select("chr", F.col("child").alias("node"), "bp"), "mutations")
    moved = ancestry.descend(nodes, e)
    return nodes.groupBy("chr").agg(F.count(F.lit(1)).alias("mutations")).join(moved.groupBy("chr").agg(F.count(F.lit(1)).alias("moved")), "chr", "left").withColumn("moved", F.coalesce("moved", F.lit(0)))


_KEY = ("gen", "chr", "parent", "child", '"left"')
register(
    "overlay_propagate",
    overlay_propagate,
    f"""WITH {_EDGES}, n AS (SELECT *, {_poisson_sql('u', 0.5)} AS k FROM (SELECT *, {_q('=4', '=m', *_KEY)} AS u FROM edges)),
x AS (SELECT *, unnest(range(1, k + 1)) AS i FROM n), m AS (SELECT chr, child AS node, "left" + floor({_q('=4', '=p', *_KEY, 'i')} * ("right" - "left"))::BIGINT AS bp FROM x),
v AS (SELECT m.chr, count(*) AS moved FROM m JOIN edges e ON e.chr = m.chr AND e.parent = m.node AND m.bp >= e.left AND m.bp < e.right GROUP BY m.chr)
SELECT m.chr, count(*) AS mutations, coalesce(max(v.moved), 0) AS moved FROM m LEFT JOIN v ON v.chr = m.chr GROUP BY m.chr""",
)
register(
    "merged_sites",
    lambda s, d: _rounded(ancestry.merged_sites(views.part_variants(s, d).where("is_qtl"), views.edges(s, d).select("chr", F.col("left").cast("int").alias("bp"))), "alpha"),
    f"""WITH {_GENO2}, {_EDGES} SELECT chr, bp, 'chr' || chr || '_' || bp || '_q' AS snp_id, {_r('alpha')} AS alpha FROM parts WHERE is_qtl
UNION ALL SELECT DISTINCT chr, "left"::INTEGER, 'chr' || chr || '_' || "left" || '_n', 0.0::DOUBLE FROM edges""",
)
register(
    "node_renumber",
    lambda s, d: ancestry.renumber(views.edges(s, d).select("chr", F.col("child").alias("node")).distinct(), 100),
    f"""WITH {_EDGES}, n AS (SELECT DISTINCT chr, child AS node FROM edges), b AS (SELECT chr, sum(c) OVER (ORDER BY chr) - c AS base FROM (SELECT chr, count(*) FILTER (WHERE node > 100) AS c FROM n GROUP BY chr))
SELECT chr, node, (CASE WHEN node <= 100 THEN node ELSE node + base END)::BIGINT AS new_node FROM n JOIN b USING (chr)""",
)
register(
    "tbl_per_bp",
    lambda s, d: _rounded(ancestry.branch_length_per_bp(views.edges(s, d).withColumn("length", F.col("gen")), views.CHR_LEN), "tbl"),
    f'WITH {_EDGES} SELECT chr, {_r("""sum(gen * ("right" - "left"))::DOUBLE / 100000""")} AS tbl FROM edges GROUP BY chr',
)

# --- files and long tables ---------------------------------------------------------------------------------------

register(
    "plink_codes",
    lambda s, d: views.dosages(s, d).select(plink.code(F.col("g")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {_GENO2} SELECT CASE g WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END AS code, count(*) AS n FROM geno2 GROUP BY 1",
)
register(
    "plink_bim",
    lambda s, d: plink.bim(views.part_variants(s, d), 1e-8),
    f"WITH {_GENO2} SELECT chr, bp, chr || chr(9) || 'chr' || chr || '_' || bp || chr(9) || printf('%.6f', bp * 1e-8 * 100) || chr(9) || bp || chr(9) || '1' || chr(9) || '0' AS line FROM parts",
)


def fam_deme_parse(s: SparkSession, d: str) -> DataFrame:
    hap, variants = _genotypes(s, d)
    return _rounded(plink.parse_fam(plink.fam(stats.breeding_values(hap, variants))), "phenotype")


register("fam_deme_parse", fam_deme_parse, f"WITH {V} SELECT 'p' || deme || '_' || ind_id AS iid, deme::INTEGER AS deme, {_r('round(a, 6)')} AS phenotype FROM bv")
register(
    "kv_unpivot",
    lambda s, d: _rounded(stats.bulmer_per_deme(*_genotypes(s, d)).unpivot(["deme"], ["va", "genic", "b"], "key", "value"), "value"),
    f"{_DEME}, t AS (SELECT deme, va, genic, (va - genic) / genic AS b FROM dv JOIN dg USING (deme)) SELECT deme, 'va' AS key, {_r('va')} AS value FROM t UNION ALL SELECT deme, 'genic', {_r('genic')} FROM t UNION ALL SELECT deme, 'b', {_r('b')} FROM t",
)
register(
    "seed_median_pivot",
    lambda s, d: _rounded(views.table(s, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.median("value")), "click", "view", "purchase"),
    f"SELECT user_id, {_r('''median(value) FILTER (WHERE event_type = 'click')''')} AS click, {_r('''median(value) FILTER (WHERE event_type = 'view')''')} AS view, {_r('''median(value) FILTER (WHERE event_type = 'purchase')''')} AS purchase FROM events GROUP BY user_id",
)
register(
    "selection_class",
    lambda s, d: views.table(s, d, "lineitem").select(ld.selection_class(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") - 25).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN l_tax >= 0.05 THEN 'neutral' WHEN l_discount >= 0.05 THEN 'stabilizing' WHEN l_quantity - 25 > 0 THEN 'directional+' ELSE 'directional-' END AS class, count(*) AS n FROM lineitem GROUP BY 1",
)


# --- generations and streams -------------------------------------------------------------------------------------


def one_generation(s: SparkSession, d: str) -> DataFrame:
    """One generation from the stored haplotypes: each deme's size, variance and factor after it. No SQL: tests hold it."""
    hap, variants = _genotypes(s, d)
    after = generations.next_generation(hap, variants, 1, seed=1, chr_len=views.CHR_LEN, vs=0.5, mutation=1e-3)
    return _rounded(stats.bulmer_per_deme(after, variants), "va", "genic", "b")


register("one_generation", one_generation)
register(
    "monitor_windows",
    lambda s, d: _rounded(monitor.windows(views.table(s, d, "events").select("ts", F.col("event_type").alias("key"), "value")), "mean", "sd"),
    f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS key, count(*) AS n, {_r('avg(value)')} AS mean, {_r('stddev_samp(value)')} AS sd FROM events GROUP BY ALL",
)

# --- further tests and summaries ---------------------------------------------------------------------------------


def mahal_3d(s: SparkSession, d: str) -> DataFrame:
    """Both scopes' B and the direction against their sign-flip cloud."""
    geno, sites = _ld(s, d)
    y = sites.join(ld.permutation_signs(sites, N_PERM), "slot").groupBy("perm").agg(F.sum(F.col("sign") * F.col("alpha") * F.col("p")).alias("y"))
    points = _null_b(s, d).join(y, "perm").select("genome", "within", "y")
    observed = ld.scope_b(ld.scope_values(geno, sites)).crossJoin(sites.agg(F.sum(F.col("alpha") * F.col("p")).alias("y")))
    return _rounded(ld.radial_test(points, observed, ["genome", "within", "y"]), "radius", "p")


register(
    "mahal_3d",
    mahal_3d,
    f"""WITH {V}, {_NULL}, {_OBSERVED}, y AS (SELECT perm, sum(sign * alpha * p) AS y FROM qtl JOIN signs USING (slot) GROUP BY perm),
m AS (SELECT avg(genome) AS m1, stddev_samp(genome) AS s1, avg(within) AS m2, stddev_samp(within) AS s2, avg(y) AS m3, stddev_samp(y) AS s3 FROM nul JOIN y USING (perm)),
o AS (SELECT (genome - m1) / s1 AS o1, (within - m2) / s2 AS o2, ((SELECT sum(alpha * p) FROM qtl) - m3) / s3 AS o3 FROM obs, m),
e AS (SELECT o1 * o1 + o2 * o2 + o3 * o3 AS sq, o1 * (genome - m1) / s1 + o2 * (within - m2) / s2 + o3 * (y - m3) / s3 AS along FROM nul JOIN y USING (perm), m, o)
SELECT {_r('sqrt(max(sq))')} AS radius, {_r('(1 + count(*) FILTER (WHERE along >= sq))::DOUBLE / (1 + count(*))')} AS p FROM e""",
)


def response_summary(s: SparkSession, d: str) -> DataFrame:
    """Change of trait sites from the first half of the haplotypes to the second, as if one came from the other."""
    hap, variants = _genotypes(s, d)
    half = F.pmod(F.floor(F.col("hap_id") / 2), F.lit(2))
    return _rounded(ld.response(ld.trait_sites(hap.where(half == 0), variants), ld.trait_sites(hap.where(half == 1), variants, 0.0)), "d_mean_a", "d_p", "mean_abs")


register(
    "response_summary",
    response_summary,
    f"""WITH {V}, f0 AS (SELECT slot, avg(allele) AS p FROM hap WHERE ind_id % 2 = 0 GROUP BY slot), f1 AS (SELECT slot, avg(allele) AS p FROM hap WHERE ind_id % 2 = 1 GROUP BY slot),
b AS (SELECT chr, bp, alpha, f0.p, CASE WHEN f1.p > 0 AND f1.p < 1 THEN f1.p ELSE 0 END AS p2 FROM variants JOIN f0 USING (slot) JOIN f1 USING (slot) WHERE is_qtl AND alpha <> 0 AND least(f0.p, 1 - f0.p) >= 0.01),
x AS (SELECT *, CASE WHEN alpha > 0 THEN p2 - p ELSE p - p2 END AS d FROM b)
SELECT count(*) AS n_standing, count(*) FILTER (WHERE p2 > 0 AND p2 < 1) AS n_alive, {_r('sum(2 * alpha * (p2 - p))')} AS d_mean_a, {_r('avg(d)')} AS d_p, {_r('avg(abs(d))')} AS mean_abs FROM x""",
)


def haplotype_r2(s: SparkSession, d: str) -> DataFrame:
    hap, variants = _genotypes(s, d)
    return _rounded(ld.haplotype_r2(hap, ld.trait_sites(hap, variants), views.CHR_LEN / 4, state.written), "r2")


register(
    "haplotype_r2",
    haplotype_r2,
    f"""WITH {V}, pairs AS (SELECT a.slot AS j, b.slot AS k FROM qtl a JOIN qtl b ON a.chr = b.chr AND a.slot < b.slot AND abs(a.bp - b.bp) <= 25000),
m AS (SELECT j, k, avg(x.allele * y.allele) AS pxy, avg(x.allele) AS px, avg(y.allele) AS py FROM pairs JOIN hap x ON x.slot = j JOIN hap y ON y.slot = k AND y.hap_id = x.hap_id GROUP BY ALL)
SELECT j::INTEGER AS j, k::INTEGER AS k, {_r('CASE WHEN px * (1 - px) * py * (1 - py) > 0 THEN (pxy - px * py) ** 2 / (px * (1 - px) * py * (1 - py)) END')} AS r2 FROM m""",
)


def msd_metrics(s: SparkSession, d: str) -> DataFrame:
    """Mutation-selection-drift scalars for each deme of the stored haplotypes, with V_S twenty times V_P and h2 a half."""
    b = stats.bulmer_per_deme(*_genotypes(s, d))
    vp, ne = 2 * F.col("va"), F.col("n").cast("double")
    vs, nm = 20 * vp, 4 * ne * 0.05
    out = b.select("deme", "n", (ne * 10 * nm / (1 + nm)).alias("ne_island"), F.sqrt(vs / (2 * ne)).alias("delta"), genetics.half_life(vs, vp, F.lit(0.5)).alias("half_life"), (F.log(F.lit(2.0)) * vs / F.col("va")).alias("half_life_approx"))
    return _rounded(out, "ne_island", "delta", "half_life", "half_life_approx")


register(
    "msd_metrics",
    msd_metrics,
    f"""{_DEME} SELECT deme, n, {_r('n * 10.0 * (4 * n * 0.05::DOUBLE) / (1 + 4 * n * 0.05::DOUBLE)')} AS ne_island, {_r('sqrt(40 * va / (2 * n))')} AS delta,
{_r('ln(2.0) * (2 * va + 40 * va) / (0.5 * 2 * va)')} AS half_life, {_r('ln(2.0) * 40 * va / va')} AS half_life_approx FROM dv""",
)
register(
    "constraint_checks",
    lambda s, d: stats.bulmer_per_deme(*_genotypes(s, d)).select("deme", F.when(F.col("n") < 25, "WARNING").otherwise("OK").alias("size"), F.when(F.abs("b") > 0.5, "CHECK").when(F.abs("b") > 0.2, "WARNING").otherwise("OK").alias("bulmer")),
    f"{_DEME} SELECT deme, CASE WHEN n < 25 THEN 'WARNING' ELSE 'OK' END AS size, CASE WHEN abs((va - genic) / genic) > 0.5 THEN 'CHECK' WHEN abs((va - genic) / genic) > 0.2 THEN 'WARNING' ELSE 'OK' END AS bulmer FROM dv JOIN dg USING (deme)",
)
