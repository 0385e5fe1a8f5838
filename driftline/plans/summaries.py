"""Registers coalescence within and between demes, tables of configurations, and checks of runs, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import catalog as c
from driftline.functions.rng import normal, uniform
from driftline.operators import coalescence, configurations, initial, ld, selection, spatial, stats
from driftline.operators.ranges import in_order
from driftline.plans.populations import _ROUND, _TESTS, WINDOWS, _q
from driftline.registry import register
from driftline.sources import archive, state, views

# --- coalescence -------------------------------------------------------------------------------------------------

#: Nodes of the genealogy above customers: nations, market segments, regions and the root, each with its age.
_NODE_BASE = {"nation": 1_000_000_000, "segment": 1_100_000_000, "region": 1_200_000_000, "root": 1_300_000_000}
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _genealogy(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as samples of 100 positions: below a place of its own a customer descends from its nation, above from its
    segment; nations from their region, regions and segments from the root. Demes are the customers' regions."""
    customers = views.table(s, d, "customer").join(views.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segment = F.array_position(F.array(*map(F.lit, _SEGMENTS)), F.col("c_mktsegment"))
    cut = (1 + F.floor(F.abs("c_acctbal") * 100) % 100).cast("long")
    rows = customers.select(F.col("c_custkey").alias("child"), (_NODE_BASE["nation"] + F.col("c_nationkey")).alias("nation"), (_NODE_BASE["segment"] + segment).alias("segment"), (_NODE_BASE["region"] + F.col("n_regionkey")).alias("region"), F.col("n_regionkey").alias("deme"), cut.alias("cut"))
    edge = lambda left, right, parent, child: F.struct(F.lit(1).alias("chr"), left.cast("long").alias("left"), right.cast("long").alias("right"), parent.cast("long").alias("parent"), child.cast("long").alias("child"))
    one, end, root = F.lit(1), F.lit(101), F.lit(_NODE_BASE["root"])
    own = F.array(edge(one, F.col("cut"), F.col("nation"), F.col("child")), edge(F.col("cut"), end, F.col("segment"), F.col("child")))
    upper = F.array(edge(one, end, F.col("region"), F.col("nation")), edge(one, end, root, F.col("region")), edge(one, end, root, F.col("segment")))
    edges = rows.select(F.explode(own).alias("e")).select("e.*").where("left < right").unionByName(rows.select("nation", "segment", "region").distinct().select(F.explode(upper).alias("e")).select("e.*").distinct())
    age = F.when(F.col("node") >= _NODE_BASE["root"], 3.5).when(F.col("node") >= _NODE_BASE["region"], 2.0).when(F.col("node") >= _NODE_BASE["segment"], 1.5).when(F.col("node") >= _NODE_BASE["nation"], 1.0).otherwise(0.0)
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct().withColumn("time", age)
    return edges, nodes, rows.select(F.col("child").alias("node"), "deme")


def mrca_fst(s: SparkSession, d: str) -> DataFrame:
    sums = state.written(coalescence.coalescence_sums(*_genealogy(s, d), state.written), "sums")
    return c._rounded(coalescence.mrca_fst(sums).crossJoin(sums.agg(F.count(F.lit(1)).alias("stretches"))), "t_within", "t_between", "fst")  # one row each


register(
    "mrca_fst",
    mrca_fst,
    f"""WITH cu AS (SELECT c_custkey, c_nationkey AS nation, c_mktsegment AS segment, n_regionkey AS region, 1 + floor(abs(c_acctbal) * 100)::BIGINT % 100 AS cut FROM customer JOIN nation ON c_nationkey = n_nationkey),
en AS (SELECT DISTINCT cut AS x FROM cu WHERE cut > 1 UNION SELECT 1 UNION SELECT 101), st AS (SELECT x, lead(x) OVER (ORDER BY x) - x AS span FROM en), sp AS (SELECT * FROM st WHERE span IS NOT NULL),
tip AS (SELECT x, span, region AS deme, CASE WHEN x < cut THEN 'n' || nation ELSE 's' || segment END AS a, CASE WHEN x < cut THEN 'r' || region ELSE 's' || segment END AS b FROM sp, cu),
na AS (SELECT x, span, a, b, deme, count(*)::DOUBLE AS k FROM tip GROUP BY ALL),
pa AS (SELECT x, span, a, b, sum(k * (k - 1) / 2) AS w, sum(k) * (sum(k) - 1) / 2 AS e FROM na GROUP BY x, span, a, b),
nb AS (SELECT x, span, b, deme, sum(k) AS k FROM na GROUP BY x, span, b, deme), pb AS (SELECT x, span, b, sum(k * (k - 1) / 2) AS w, sum(k) * (sum(k) - 1) / 2 AS e FROM nb GROUP BY x, span, b),
nr AS (SELECT x, span, deme, sum(k) AS k FROM nb GROUP BY x, span, deme), pr AS (SELECT x, span, sum(k * (k - 1) / 2) AS w, sum(k) * (sum(k) - 1) / 2 AS e FROM nr GROUP BY x, span),
ev AS (SELECT x, span, CASE WHEN left(a, 1) = 's' THEN 1.5 ELSE 1 END::DOUBLE AS t, w, e FROM pa
  UNION ALL SELECT pb.x, pb.span, CASE WHEN left(pb.b, 1) = 's' THEN 1.5 ELSE 2 END, pb.w - q.w, pb.e - q.e FROM pb JOIN (SELECT x, b, sum(w) AS w, sum(e) AS e FROM pa GROUP BY x, b) q USING (x, b)
  UNION ALL SELECT pr.x, pr.span, 3.5, pr.w - q.w, pr.e - q.e FROM pr JOIN (SELECT x, sum(w) AS w, sum(e) AS e FROM pb GROUP BY x) q USING (x)),
tt AS (SELECT sum(span * t * w) / sum(span * w) AS tw, sum(span * t * (e - w)) / sum(span * (e - w)) AS tb FROM ev)
SELECT {c._r('tw')} AS t_within, {c._r('tb')} AS t_between, {c._r('1 - tw / tb')} AS fst, (SELECT count(*) FROM sp) AS stretches FROM tt""",
)

# --- configurations ----------------------------------------------------------------------------------------------


def _configs(s: SparkSession, d: str) -> DataFrame:
    """A configuration for each customer, from its balance, nation and segment."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    a, n, k = F.col("c_acctbal").cast("double"), F.col("c_nationkey"), F.col("c_custkey")
    return views.table(s, d, "customer").select(
        k.alias("config"), F.floor(a).alias("n"), (F.floor(a) + n).alias("ne"), (100 * n - 100).alias("n_qtl"), (a / 10_000).alias("h2"), (a / 20_000).alias("migration"), (1 + a / 5_000).alias("expansion"),
        pick(("neutral", "stabilizing", "directional", "sideways"), n % 4).alias("selection"), pick(configurations.NAMES["init"], n % 8).alias("init"), pick(configurations.NAMES["mutation_model"], k % 2).alias("mutation_model"),
        pick(configurations.NAMES["demography"], n % 3).alias("demography"), (n % 5).alias("grid"), (k % 3).alias("recent"), F.when(n % 6 == 0, a / 9_000).alias("f_neutral"), (F.col("c_mktsegment") == "BUILDING").alias("recap"),
    )


_CONFIGS = """cf AS (SELECT c_custkey AS config, floor(c_acctbal)::BIGINT AS n, floor(c_acctbal)::BIGINT + c_nationkey AS ne, 100 * c_nationkey - 100 AS n_qtl, c_acctbal / 10000 AS h2, c_acctbal / 20000 AS migration, 1 + c_acctbal / 5000 AS expansion,
  ['neutral', 'stabilizing', 'directional', 'sideways'][c_nationkey % 4 + 1] AS selection, ['beta_mutation_drift', 'beta_asymmetric', 'uniform', 'fixed_p', 'empirical_sfs', 'ism_watterson', 'ism_denovo', 'from_recap'][c_nationkey % 8 + 1] AS init,
  ['finite_sites', 'infinite_sites'][c_custkey % 2 + 1] AS mutation_model, ['panmictic', 'twoD_perp', 'twoD_recent'][c_nationkey % 3 + 1] AS demography, c_nationkey % 5 AS grid, c_custkey % 3 AS recent,
  CASE WHEN c_nationkey % 6 = 0 THEN c_acctbal / 9000 END AS f_neutral, c_mktsegment = 'BUILDING' AS recap FROM customer),
de AS (SELECT *, CASE WHEN f_neutral < 1 THEN round(n_qtl * f_neutral / (1 - f_neutral))::BIGINT ELSE 0 END AS n_neutral FROM cf),
ra AS (SELECT *, CASE WHEN n_qtl > 0 THEN 0.01::DOUBLE * n_neutral / n_qtl ELSE 0 END AS u_neutral FROM de),
hn AS (SELECT *, 2 * ne - 1 AS m FROM ra),
ex AS (SELECT *, 4.0::DOUBLE * ne * (0.01 + u_neutral) * CASE WHEN m < 1 THEN 0 WHEN m < 100 THEN list_sum(list_transform(range(1, m + 1), lambda j: 1.0::DOUBLE / j)) ELSE ln(m) + 0.5772156649015329 + 1.0::DOUBLE / (2 * m) - 1.0::DOUBLE / (12.0::DOUBLE * m * m) + 1.0::DOUBLE / (120.0::DOUBLE * m * m * m * m) END AS es FROM hn),
ca AS (SELECT *, CASE WHEN mutation_model = 'finite_sites' THEN n_qtl + n_neutral ELSE least(greatest(64, ceil(4 * es)), 10000000)::BIGINT END AS capacity FROM ex)"""
register("config_violations", lambda s, d: configurations.violations(_configs(s, d), "config"), f"""WITH {_CONFIGS}
SELECT config, unnest(list_filter([CASE WHEN n <= 0 THEN 'n' END, CASE WHEN ne <= 0 THEN 'ne' END, CASE WHEN f_neutral < 0 OR f_neutral >= 1 THEN 'f_neutral' END, CASE WHEN f_neutral IS NOT NULL AND n_qtl <= 0 THEN 'f_neutral_needs_traits' END,
  CASE WHEN n_qtl < 0 THEN 'n_qtl' END, CASE WHEN n_neutral < 0 THEN 'n_neutral' END, CASE WHEN n_qtl + n_neutral <= 0 THEN 'some_sites' END, CASE WHEN n_qtl + n_neutral > 10000000 THEN 'sites_fit' END, CASE WHEN mutation_model <> 'finite_sites' AND capacity <= 0 THEN 'capacity' END,
  CASE WHEN n_qtl <= 0 THEN 'u_qtl_needs_traits' END, CASE WHEN n_neutral <> 0 AND u_neutral <= 0 THEN 'neutral_needs_rate' END, CASE WHEN u_neutral <> 0 AND n_neutral <= 0 THEN 'rate_needs_neutral' END,
  CASE WHEN h2 <= 0 OR h2 >= 1 THEN 'h2' END, CASE WHEN selection = 'sideways' THEN 'selection' END,
  CASE WHEN recap AND init <> 'from_recap' THEN 'recap_needs_init' END, CASE WHEN NOT recap AND init = 'from_recap' THEN 'init_needs_recap' END,
  CASE WHEN mutation_model = 'infinite_sites' AND init NOT IN ('ism_watterson', 'ism_denovo', 'from_recap') THEN 'infinite_init' END, CASE WHEN mutation_model = 'finite_sites' AND init IN ('ism_watterson', 'ism_denovo') THEN 'finite_init' END,
  CASE WHEN grid < 1 THEN 'grid' END, CASE WHEN demography = 'panmictic' AND grid <> 1 THEN 'panmictic_grid' END, CASE WHEN demography <> 'panmictic' AND grid < 2 THEN 'demes_grid' END, CASE WHEN demography = 'twoD_recent' AND recent < 1 THEN 'recent' END,
  CASE WHEN grid > 1 AND migration < 0 THEN 'migration' END, CASE WHEN grid > 1 AND migration > 0.25 THEN 'emigration' END, CASE WHEN expansion < 1 THEN 'expansion' END, CASE WHEN expansion > 1 AND floor(expansion * n) <= n THEN 'expansion_grows' END], lambda v: v IS NOT NULL)) AS rule FROM ca""")


def config_derived(s: SparkSession, d: str) -> DataFrame:
    """What follows from each configuration, theta by class among it."""
    names = ("theta_qtl", "theta_neutral", "mu_per_bp", "recombination_per_bp")
    return c._rounded(configurations.derived(_configs(s, d)).select("config", "n_neutral", "recap_burnin", "n_demes", "n_total", "capacity", *[(F.col(x) * (1e6 if x.endswith("bp") else 1)).alias(x) for x in names]), *names)


register(
    "config_derived",
    config_derived,
    f"""WITH {_CONFIGS} SELECT config, n_neutral, CASE WHEN recap THEN recent ELSE 0 END AS recap_burnin, grid * grid AS n_demes, n * grid * grid AS n_total, capacity,
{c._r('CASE WHEN n_qtl > 0 THEN 4.0 * ne * (0.01::DOUBLE / n_qtl) ELSE 0 END')} AS theta_qtl, {c._r('CASE WHEN n_neutral > 0 THEN 4.0 * ne * (u_neutral / n_neutral) ELSE 0 END')} AS theta_neutral,
{c._r('(0.01::DOUBLE + u_neutral) / 10000000 * 1e6')} AS mu_per_bp, {c._r('1.0::DOUBLE / 1000000 * 1e6')} AS recombination_per_bp FROM ca""",
)

# --- checks of runs ----------------------------------------------------------------------------------------------


def _runs(s: SparkSession, d: str) -> DataFrame:
    """A run for each deme of the stored haplotypes: V_S from the number of the deme, a shift in every second one."""
    hap, variants = c._genotypes(s, d)
    effects = variants.where("is_qtl").agg(F.avg(F.col("alpha") * F.col("alpha")).alias("alpha_sq"), F.avg(F.abs("alpha")).alias("alpha_abs"))
    b = stats.bulmer_per_deme(hap, variants).crossJoin(F.broadcast(effects))  # one row
    k = F.col("deme")
    return b.select("deme", F.col("n").cast("long").alias("n"), F.col("n").cast("long").alias("ne"), (1 + k % 3).alias("grid"), F.lit(0.05).alias("migration"), F.lit(0.4).alias("u"), ((1 + k) * 15 * F.col("va")).alias("vs"), (2 * F.col("va")).alias("vp"), F.col("va").alias("va_breeding"), F.lit(0.5).alias("h2"), "alpha_sq", "alpha_abs", F.when(k % 2 == 0, 0.0).otherwise(0.2).alias("shift"), (k % 5 == 4).alias("neutral"))


register(
    "run_checks",
    lambda s, d: c._rounded(configurations.run_checks(configurations.run_metrics(_runs(s, d)), "deme"), "value", "bound"),
    f"""{c._DEME}, ef AS (SELECT avg(alpha * alpha) AS a2, avg(abs(alpha)) AS a1 FROM variants WHERE is_qtl),
ru AS (SELECT deme, va, 2 * va AS vp, (1 + deme) * 15 * va AS vs, a2, a1, CASE WHEN deme % 2 = 0 THEN 0 ELSE 0.2::DOUBLE END AS shift, deme % 5 = 4 AS neutral, CASE WHEN deme % 3 > 0 THEN n * (1 + deme % 3) ** 2 * (4.0 * n * 0.05) / (1 + 4.0 * n * 0.05) ELSE n END::DOUBLE AS ne FROM dv, ef),
me AS (SELECT *, sqrt(2 * ne * 0.4::DOUBLE) AS root, CASE WHEN shift = 0 THEN 0 ELSE a1 * abs(shift) / vs END AS sd, 4 * ne * a2 / vs AS se, sqrt(vs / (2 * ne)) AS delta, shift / vs AS beta FROM ru),
ck AS (SELECT deme, neutral, unnest([
  {{'check': '1 polygenicity', 'value': root, 'bound': 10.0::DOUBLE, 'status': CASE WHEN root > 10 THEN 'ok' ELSE 'warning' END}}, {{'check': '2 load', 'value': 0.4::DOUBLE, 'bound': NULL::DOUBLE, 'status': 'told'}},
  {{'check': '3 vp over vs', 'value': vp / vs, 'bound': 0.1::DOUBLE, 'status': CASE WHEN vp / vs < 0.1 THEN 'ok' ELSE 'warning' END}}, {{'check': '3b va over vs', 'value': va / vs, 'bound': 0.01::DOUBLE, 'status': CASE WHEN va / vs >= 0.001 AND va / vs <= 0.01 THEN 'ok' ELSE 'check' END}},
  {{'check': '4 shift', 'value': abs(shift), 'bound': sqrt(vs), 'status': CASE WHEN abs(shift) <= sqrt(vs) THEN 'ok' ELSE 'warning' END}}, {{'check': '5 response', 'value': abs(shift) / sqrt(vp), 'bound': 0.5 * root, 'status': CASE WHEN abs(shift) / sqrt(vp) < 0.5 * root THEN 'ok' ELSE 'warning' END}},
  {{'check': '6 scaled s', 'value': se, 'bound': 5.0::DOUBLE, 'status': CASE WHEN se < 5 THEN 'polygenic' ELSE 'oligogenic' END}}, {{'check': '7 small effects', 'value': a1 / sqrt(vs), 'bound': 0.1::DOUBLE, 'status': CASE WHEN a1 / sqrt(vs) < 0.1 THEN 'ok' ELSE 'warning' END}},
  {{'check': '8 directional', 'value': sd, 'bound': 0.1::DOUBLE, 'status': CASE WHEN sd < 0.1 THEN 'ok' ELSE 'warning' END}}, {{'check': '9 detectable', 'value': abs(shift), 'bound': delta, 'status': CASE WHEN shift = 0 THEN 'no shift' WHEN abs(shift) > delta THEN 'ok' ELSE 'warning' END}},
  {{'check': '10 gradient', 'value': abs(beta), 'bound': 0.1::DOUBLE, 'status': CASE WHEN abs(beta) < 0.1 THEN 'ok' ELSE 'warning' END}}, {{'check': '10b per deviation', 'value': abs(beta * sqrt(vp)), 'bound': 0.1::DOUBLE, 'status': CASE WHEN abs(beta * sqrt(vp)) < 0.1 THEN 'ok' ELSE 'warning' END}}]) AS r FROM me)
SELECT deme, r.check AS "check", {c._r('r.value')} AS value, {c._r('r.bound')} AS bound, r.status AS status FROM ck WHERE NOT neutral OR r.check IN ('1 polygenicity', '2 load')""",
)

# --- files of summaries ------------------------------------------------------------------------------------------

_NOISE = 0.4


def final_summary(s: SparkSession, d: str) -> DataFrame:
    """The end of a run as a file of keys, written and read: its settings and what the stored haplotypes realize."""
    hap, variants = c._genotypes(s, d)
    noise = normal(uniform(31, "e1", F.col("ind_id")), uniform(31, "e2", F.col("ind_id")), _NOISE)
    realized = stats.final_summary(hap, variants, noise)
    settings = variants.agg(F.count(F.lit(1)).alias("n_sites"), F.count_if("is_qtl").alias("n_qtl")).withColumn("sigma_e", F.lit(_NOISE))
    path = state.new_folder(s, "final")
    archive.write_keys(path, {"config": settings, "realized": c._rounded(realized, *[k for k, kind in realized.dtypes if kind == "double"])})
    return archive.read_summary(s, [path]).select("key", F.col("value").cast("double").alias("value"))


_REALIZED = ("mean_a", "var_a", "genic", "b", "var_pheno", "h2", "var_a_pooled", "genic_pooled", "b_pooled", "mean_alpha_sq", "mean_abs_alpha")
register(
    "final_summary",
    final_summary,
    f"""{c._DEME}, z AS (SELECT deme, count(*) AS n, avg(a) AS m, var_samp(a) AS va, var_samp(a + sqrt(-2 * ln({_q('=31', '=e1', 'ind_id')})) * cos(2 * pi() * {_q('=31', '=e2', 'ind_id')}) * {_NOISE}::DOUBLE) AS vz FROM bv GROUP BY deme),
w AS (SELECT sum(n * m) / sum(n) AS mean_a, sum(n * va) / sum(n) AS var_a, sum(n * genic) / sum(n) AS genic, sum(n * (va - genic) / genic) / sum(n) AS b, sum(n * vz) / sum(n) AS var_pheno FROM z JOIN dg USING (deme)),
q AS (SELECT sum(2 * p * (1 - p) * alpha * alpha) FILTER (is_qtl) AS genic_pooled, count(*) FILTER (p > 1e-12 AND p < 1 - 1e-12) AS n_polymorphic, count(*) FILTER (is_qtl AND p > 1e-12 AND p < 1 - 1e-12) AS n_qtl_polymorphic,
  avg(alpha * alpha) FILTER (is_qtl AND p > 1e-12 AND p < 1 - 1e-12) AS mean_alpha_sq, avg(abs(alpha)) FILTER (is_qtl AND p > 1e-12 AND p < 1 - 1e-12) AS mean_abs_alpha FROM freq JOIN variants USING (slot)),
f AS (SELECT *, var_a / var_pheno AS h2, (var_a_pooled - genic_pooled) / genic_pooled AS b_pooled FROM w, q, (SELECT var_samp(a) AS var_a_pooled FROM bv))
"""
    + " UNION ALL ".join([*(f"SELECT 'realized.{k}' AS key, {c._r(k)} AS value FROM f" for k in _REALIZED), *(f"SELECT 'realized.{k}', {k}::DOUBLE FROM f" for k in ("n_polymorphic", "n_qtl_polymorphic")), f"SELECT 'config.sigma_e', {_NOISE}::DOUBLE", "SELECT 'config.n_sites', count(*)::DOUBLE FROM variants", "SELECT 'config.n_qtl', count(*)::DOUBLE FROM variants WHERE is_qtl"]),
)


def _halves(s: SparkSession, d: str) -> DataFrame:
    hap, variants = c._genotypes(s, d)
    half = F.pmod(F.floor(F.col("hap_id") / 2), F.lit(2))
    return ld.response(ld.trait_sites(hap.where(half == 0), variants), ld.trait_sites(hap.where(half == 1), variants, 0.0))


_TOLD = tuple(k for k in _ROUND if k != "va")


def selection_file(s: SparkSession, d: str) -> DataFrame:
    """Selection tests as a file of keys, written and read: the run's own, those of each scope, and the response."""
    geno, sites = c._ld(s, d)
    points = state.written(selection.sign_flip_points(geno, sites, WINDOWS, views.CHR_LEN, c.N_PERM), "points")
    tests = selection.every_scope(selection.selection_tests(points), sites, WINDOWS)
    meta = sites.agg(F.count(F.lit(1)).alias("n_loci")).withColumns({"n_perm": F.lit(c.N_PERM), "seed": F.lit(1), "maf_min": F.lit(0.01), "windows": F.lit(len(WINDOWS))})
    path = state.new_folder(s, "selection")
    told = c._rounded(tests.select("scope", "n_loci", "n_perm", *_TOLD), *_TOLD)
    archive.write_keys(path, {"meta": meta, "": told, "response": c._rounded(_halves(s, d), "d_mean_a", "d_p", "mean_abs")}, {"": "scope"})
    return archive.read_summary(s, [path]).select("key", F.col("value").cast("double").alias("value"))


_RESPONSE = f"""f0 AS (SELECT slot, avg(allele) AS p FROM hap WHERE ind_id % 2 = 0 GROUP BY slot), f1 AS (SELECT slot, avg(allele) AS p FROM hap WHERE ind_id % 2 = 1 GROUP BY slot),
hb AS (SELECT alpha, f0.p, CASE WHEN f1.p > 0 AND f1.p < 1 THEN f1.p ELSE 0 END AS p2 FROM variants JOIN f0 USING (slot) JOIN f1 USING (slot) WHERE is_qtl AND alpha <> 0 AND least(f0.p, 1 - f0.p) >= 0.01),
hx AS (SELECT *, CASE WHEN alpha > 0 THEN p2 - p ELSE p - p2 END AS d FROM hb),
rs AS (SELECT count(*)::DOUBLE AS n_standing, (count(*) FILTER (p2 > 0 AND p2 < 1))::DOUBLE AS n_alive, {c._r('sum(2 * alpha * (p2 - p))')} AS d_mean_a, {c._r('avg(d)')} AS d_p, {c._r('avg(abs(d))')} AS mean_abs FROM hx)"""
register(
    "selection_file",
    selection_file,
    f"WITH {c.V}, {_TESTS}, {_RESPONSE} "
    + " UNION ALL ".join([
        *(f"SELECT scope || '.{k}' AS key, coalesce({c._r(k)}, 'NaN'::DOUBLE) AS value FROM te" for k in _TOLD), "SELECT scope || '.n_loci', n_loci::DOUBLE FROM te", "SELECT scope || '.n_perm', n_perm::DOUBLE FROM te",
        *(f"SELECT 'response.{k}', {k} FROM rs" for k in ("n_standing", "n_alive", "d_mean_a", "d_p", "mean_abs")),
        "SELECT 'meta.n_loci', count(*)::DOUBLE FROM qtl", f"SELECT 'meta.n_perm', {c.N_PERM}::DOUBLE", "SELECT 'meta.seed', 1::DOUBLE", "SELECT 'meta.maf_min', 0.01::DOUBLE", f"SELECT 'meta.windows', {len(WINDOWS)}::DOUBLE",
    ]),
)

# --- first states and layouts ------------------------------------------------------------------------------------


def initial_frequencies(s: SparkSession, d: str) -> DataFrame:
    """A first frequency of each kind for each part."""
    site = F.col("p_partkey")
    kinds = {"even": initial.frequency("uniform", site, 41, 0.05), "fixed": initial.frequency("fixed", site, 41, 0.05, p=0.3), "half": initial.frequency("beta", site, 41), "skewed": initial.frequency("beta_asymmetric", site, 42, 0.02, 0.6, 0.3)}
    return c._rounded(views.table(s, d, "part").select(site.alias("site"), *[v.alias(k) for k, v in kinds.items()]), *kinds)


register(
    "initial_frequencies",
    initial_frequencies,
    f"""WITH t AS (SELECT p_partkey AS site, unnest(range(1, 65)) AS i FROM part), x AS (SELECT site, i, {_q('=42', '=x', 'site', 'i')} ** (1 / 0.6::DOUBLE) AS x, {_q('=42', '=y', 'site', 'i')} ** (1 / 0.3::DOUBLE) AS y FROM t),
b AS (SELECT site, arg_min(x / (x + y), i) AS p FROM x WHERE x + y <= 1 AND x + y > 0 AND least(x / (x + y), y / (x + y)) >= 0.02 GROUP BY site)
SELECT site, {c._r(f"0.05::DOUBLE + {_q('=41', '=u', 'site')} * 0.9::DOUBLE")} AS even, 0.3::DOUBLE AS fixed, 0.5::DOUBLE AS half, {c._r('p')} AS skewed FROM b""",
)
register(
    "chromosome_ranges",
    lambda s, d: initial.chromosome_ranges(views.part_variants(s, d), 7),
    f"""WITH {c._GENO2} SELECT k::INTEGER AS chr, coalesce(min(slot), 0)::BIGINT AS first, coalesce(max(slot), -1)::BIGINT AS last, count(slot) AS n_sites, count(*) FILTER (is_qtl) AS n_qtl FROM range(1, 8) r(k) LEFT JOIN parts ON chr = k GROUP BY k""",
)


def deme_layouts(s: SparkSession, d: str) -> DataFrame:
    """Customers in demes of a grid of five, before and after the grid is there: individuals of each deme."""
    people = in_order(views.table(s, d, "customer").select("c_custkey"), ["c_custkey"], "place")
    n = people.count() // 25
    rows = None
    for begun in (False, True):
        demes, per = spatial.layout("twoD_recent", n, 5, begun)
        one = people.where(F.col("place") < demes * per).groupBy(spatial.deme_of(F.col("place") + 1, per).alias("deme")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys")).withColumn("begun", F.lit(begun))
        rows = one if rows is None else rows.unionByName(one)
    return rows


register(
    "deme_layouts",
    deme_layouts,
    """WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () // 25 AS n FROM customer)
SELECT 1::BIGINT AS deme, count(*) AS n, sum(c_custkey)::BIGINT AS keys, false AS begun FROM p WHERE place < 25 * n UNION ALL SELECT (place // n + 1)::BIGINT, count(*), sum(c_custkey)::BIGINT, true FROM p WHERE place < 25 * n GROUP BY 1""",
)


def snapshot_header(s: SparkSession, d: str) -> DataFrame:
    """The header of the stored population's snapshot and its chromosomes, written and read."""
    path = state.new_folder(s, "snapshot")
    hap, variants = c._genotypes(s, d)
    archive.write_snapshot(path, hap, variants)
    archive.write_header(path, hap, variants, views.CHR_LEN, 3)
    header, chromosomes = archive.read_header(s, path)
    as_long = lambda df: df.select(*[F.col(x).cast("long").alias(x) for x in df.columns])
    return as_long(chromosomes).crossJoin(F.broadcast(as_long(header)))  # one row


register(
    "snapshot_header",
    snapshot_header,
    f"""WITH {c.V}, h AS (SELECT (SELECT count(*) FROM variants) AS sites, (SELECT count(*) FROM variants WHERE is_qtl) AS trait_sites, (SELECT count(DISTINCT slot) FROM hap WHERE allele = 1) AS active_sites,
  count(DISTINCT hap_id) AS haplotypes, count(DISTINCT ind_id) AS individuals, count(DISTINCT deme) AS demes, 3::BIGINT AS grid FROM hap)
SELECT chr::BIGINT AS chr, min(slot)::BIGINT AS first, max(slot)::BIGINT AS last, 100000::BIGINT AS length, {', '.join(f'any_value({x}) AS {x}' for x in ('sites', 'trait_sites', 'active_sites', 'haplotypes', 'individuals', 'demes', 'grid'))} FROM variants, h GROUP BY chr""",
)
