"""Linkage disequilibrium between trait sites and its sign-flip permutation tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.rng import sign
from driftline.operators import gram
from driftline.operators.stats import allele_frequency


def trait_sites(hap: DataFrame, variants: DataFrame, maf_min: float = 0.01) -> DataFrame:
    """slot, chr, bp, alpha, p of trait sites with an effect and a minor allele; without a least share, any that vary."""
    sites = variants.where("is_qtl and alpha <> 0").join(allele_frequency(hap, variants), "slot")
    minor = F.least(F.col("p"), 1 - F.col("p"))
    return sites.where(minor >= maf_min if maf_min > 0 else minor > 0).select("slot", "chr", "bp", "alpha", "p")


def scope_pairs(sites: DataFrame, window: float = 0.5, chr_len: int = 100_000) -> DataFrame:
    """Ordered pairs of different sites on one chromosome: j, k, in_window (at most half the window's length apart).

    Pairs over the genome need no rows: their sums follow from variances of whole breeding values.
    """
    other = sites.select(F.col("slot").alias("k"), "chr", F.col("bp").alias("bp2"), F.col("alpha").alias("alpha2"))
    pairs = sites.select(F.col("slot").alias("j"), "chr", "bp", "alpha").join(other, "chr").where("j <> k")
    return pairs.withColumn("in_window", F.abs(F.col("bp") - F.col("bp2")) <= window * chr_len / 2)


def covariances(geno: DataFrame, sites: DataFrame, near: float, write) -> DataFrame:
    """deme, j, k, cov: sample covariances of dosages within demes of two or more, for ordered pairs of different sites of one
    chromosome at most `near` apart. Products come as tiles along the chromosomes; only tiles in reach of each other meet."""
    cells = geno.join(sites.select("slot"), "slot", "left_semi")
    means = cells.groupBy("deme", "slot").agg(F.avg("g").alias("_m"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    scaled = cells.join(means, ["deme", "slot"]).select("deme", "ind_id", "slot", ((F.col("g") - F.col("_m")) / F.sqrt(F.col("_n") - 1)).alias("x"))
    places = write(gram.numbered(sites), "places")
    half = write(gram.pairs(gram.products(scaled, places, write, "deme", near), places, "deme", near), "covariances")
    return half.select("deme", "j", "k", F.col("r").alias("cov")).unionByName(half.select("deme", F.col("k").alias("j"), F.col("j").alias("k"), F.col("r").alias("cov")))


def scope_values(geno: DataFrame, sites: DataFrame, perm: DataFrame | None = None) -> DataFrame:
    """For each deme (and permutation): n, the variance of whole values, the sum of variances of values by chromosome,
    and the sum of single-site variances.

    With signs e on effects, the off-diagonal sum over the genome is var(X(e a)) less the single-site variances, and
    within chromosomes the sum of var(X_c(e a)) less the same; no pair of sites is formed.
    """
    cells = geno.join(F.broadcast(sites.select("slot", "chr", "alpha")), "slot")
    keys = ["deme"]
    single = cells.groupBy("deme", "slot").agg((F.var_samp("g") * F.max(F.col("alpha") * F.col("alpha"))).alias("v")).groupBy("deme").agg(F.sum("v").alias("diagonal"))
    if perm is not None:
        cells = cells.join(F.broadcast(perm), "slot").withColumn("alpha", F.col("alpha") * F.col("sign"))
        keys = ["perm", "deme"]
    parts = cells.groupBy(*keys, "ind_id", "chr").agg(F.sum(F.col("alpha") * F.col("g")).alias("a"))
    within = parts.groupBy(*keys, "chr").agg(F.var_samp("a").alias("v")).groupBy(*keys).agg(F.sum("v").alias("by_chr"))
    whole = parts.groupBy(*keys, "ind_id").agg(F.sum("a").alias("a")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_samp("a").alias("whole"))
    return whole.join(within, keys).join(single, "deme").where("n >= 3")


def scope_b(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """B by scope over demes, each one weighted by its size: off-diagonal sums over single-site variances."""
    weighted = lambda c: F.sum(F.col("n") * c) / F.sum(F.col("n") * F.col("diagonal"))
    return values.groupBy(*(by or [])).agg(weighted(F.col("whole") - F.col("diagonal")).alias("genome"), weighted(F.col("by_chr") - F.col("diagonal")).alias("within"))


def permutation_signs(sites: DataFrame, n_perm: int, seed: int = 1, block: Column | None = None) -> DataFrame:
    """slot, perm, sign; with `block` sites of a block share their signs."""
    perms = sites.select("slot", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("perm"), (block if block is not None else F.col("slot")).alias("_key"))
    return perms.select("slot", "perm", sign(seed, F.col("_key"), F.col("perm")).alias("sign"))


def one_sided(observed: DataFrame, null: DataFrame, scope: str) -> DataFrame:
    """scope, b, n_perm, p: the share of permutations, with the observation, that are not above it."""
    one = F.broadcast(observed.select(F.col(scope).alias("b")))  # one row
    return null.crossJoin(one).groupBy("b").agg(F.count(F.lit(1)).alias("n_perm"), F.count_if(F.col(scope) <= F.col("b")).alias("_n")).select(F.lit(scope).alias("scope"), "b", "n_perm", ((1 + F.col("_n")) / (1 + F.col("n_perm"))).alias("p"))


def marginal_b(geno: DataFrame, sites: DataFrame) -> DataFrame:
    """slot, b: a site's effect times its covariance with all other effects, over demes by their size."""
    cells = geno.join(F.broadcast(sites.select("slot", "alpha")), "slot")
    whole = cells.groupBy("deme", "ind_id").agg(F.sum(F.col("alpha") * F.col("g")).alias("a"))
    each = cells.join(whole, ["deme", "ind_id"]).groupBy("deme", "slot").agg(F.count(F.lit(1)).alias("n"), F.first("alpha").alias("alpha"), F.covar_samp("g", "a").alias("c"), F.var_samp("g").alias("v"))
    return each.where("n >= 3").groupBy("slot").agg((F.sum(F.col("n") * F.col("alpha") * (F.col("c") - F.col("alpha") * F.col("v"))) / F.sum("n")).alias("b"))


def polarized(p: Column, alpha: Column) -> Column:
    """The frequency of the allele that raises the trait, kept off its ends."""
    return F.greatest(F.lit(0.005), F.least(F.lit(0.995), F.when(alpha > 0, p).otherwise(1 - p)))


def direction(sites: DataFrame, signs: DataFrame) -> DataFrame:
    """value, mean, p: the sum of effects times frequencies against sign flips, on both sides of their mean."""
    observed = sites.agg(F.sum(F.col("alpha") * F.col("p")).alias("value"))
    null = sites.join(signs, "slot").groupBy("perm").agg(F.sum(F.col("sign") * F.col("alpha") * F.col("p")).alias("x"))
    centre = null.agg(F.avg("x").alias("mean"))
    both = null.crossJoin(F.broadcast(centre)).crossJoin(F.broadcast(observed))  # one row each
    return both.groupBy("value", "mean").agg(((1 + F.count_if(F.abs(F.col("x") - F.col("mean")) >= F.abs(F.col("value") - F.col("mean")))) / (1 + F.count(F.lit(1)))).alias("p"))


def ellipse_test(points: DataFrame, observed: DataFrame) -> DataFrame:
    """distance, p: Mahalanobis distance of (x, y) from null points, with a ridge of 1e-8 of the trace."""
    moments = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("sxx"), F.var_samp("y").alias("syy"), F.covar_samp("x", "y").alias("sxy"))
    ridge = 1e-8 * (F.col("sxx") + F.col("syy"))
    moments = moments.withColumn("sxx2", F.col("sxx") + ridge).withColumn("syy2", F.col("syy") + ridge).withColumn("det", F.col("sxx2") * F.col("syy2") - F.col("sxy") * F.col("sxy"))

    def distance(x: Column, y: Column) -> Column:
        dx, dy = x - F.col("mx"), y - F.col("my")
        return (F.col("syy2") * dx * dx - 2 * F.col("sxy") * dx * dy + F.col("sxx2") * dy * dy) / F.col("det")

    both = points.crossJoin(F.broadcast(moments.crossJoin(observed.select(F.col("x").alias("ox"), F.col("y").alias("oy")))))  # one row
    both = both.where("det > 1e-30").select(distance(F.col("x"), F.col("y")).alias("d"), distance(F.col("ox"), F.col("oy")).alias("o"))
    return both.groupBy("o").agg(((1 + F.count_if(F.col("d") >= F.col("o"))) / (1 + F.count(F.lit(1)))).alias("p")).select(F.sqrt("o").alias("distance"), "p")


def selection_class(p_gate: Column, p_plane: Column, direction_sign: Column, level: float = 0.05) -> Column:
    """neutral, stabilizing, or directional by the sign of the one-dimensional statistic."""
    return F.when(p_gate >= level, "neutral").when(p_plane >= level, "stabilizing").when(direction_sign > 0, "directional+").otherwise("directional-")




def radial_test(points: DataFrame, observed: DataFrame, axes: list[str]) -> DataFrame:
    """radius, p: length of the standardized observation, and how often null points reach it along its direction.

    Axes are standardized by the null's mean and deviation; null when there are under five points or an axis is constant.
    """
    moments = points.agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{t}{c}") for c in axes for t, f in (("m", F.avg), ("s", F.stddev_samp))])
    one = moments.crossJoin(observed.select(*[F.col(c).alias(f"_o{c}") for c in axes])).where(" and ".join(["_n >= 5", *[f"_s{c} > 1e-30" for c in axes]]))  # one row each
    z = lambda v, c: (v - F.col(f"_m{c}")) / F.col(f"_s{c}")
    both = points.crossJoin(F.broadcast(one))
    square = sum(z(F.col(f"_o{c}"), c) * z(F.col(f"_o{c}"), c) for c in axes)
    along = sum(z(F.col(f"_o{c}"), c) * z(F.col(c), c) for c in axes)
    return both.select(F.sqrt(square).alias("radius"), along.alias("along"), square.alias("square")).groupBy("radius").agg(((1 + F.count_if(F.col("along") >= F.col("square"))) / (1 + F.count(F.lit(1)))).alias("p"))


def response(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_standing, n_alive, d_mean_a, d_p, mean_abs: change of standing trait sites (chr, bp, alpha, p), matched by place.

    Frequencies are those of the allele that raises the trait; sites that are gone after count as unchanged in identity
    and frequency 0.
    """
    up = lambda p: F.when(F.col("alpha") > 0, p).otherwise(1 - p)
    now = after.select("chr", "bp", F.col("p").alias("p2"))
    both = before.join(now, ["chr", "bp"], "left").withColumn("p2", F.coalesce("p2", F.lit(0.0))).withColumn("d", up(F.col("p2")) - up(F.col("p")))
    return both.agg(F.count(F.lit(1)).alias("n_standing"), F.count_if((F.col("p2") > 0) & (F.col("p2") < 1)).alias("n_alive"), F.sum(2 * F.col("alpha") * (F.col("p2") - F.col("p"))).alias("d_mean_a"), F.avg("d").alias("d_p"), F.avg(F.abs("d")).alias("mean_abs"))


def haplotype_r2(hap: DataFrame, sites: DataFrame, near: float, write) -> DataFrame:
    """j, k, r2: D**2 / (p1 q1 p2 q2) over haplotypes, for pairs j < k of sites (slot, chr, bp, p) of one chromosome at most
    `near` apart; null where one does not vary. The share of haplotypes that have both is a product of tiles."""
    n = F.broadcast(hap.agg(F.count_distinct("hap_id").alias("_n")))  # one row
    cells = hap.where("allele = 1").join(sites.select("slot"), "slot", "left_semi").crossJoin(n).select(F.col("hap_id").alias("ind_id"), "slot", (1 / F.sqrt("_n")).alias("x"))
    places = write(gram.numbered(sites), "places")
    both = gram.pairs(gram.products(cells, places, write, near=near), places, near=near)
    side = lambda k, p: sites.select(F.col("slot").alias(k), F.col("p").alias(p))
    m = both.join(side("j", "px"), "j").join(side("k", "py"), "k")
    room = F.col("px") * (1 - F.col("px")) * F.col("py") * (1 - F.col("py"))
    r2 = F.when(room > 0, F.pow(F.col("r") - F.col("px") * F.col("py"), 2) / room)
    return m.select(F.least("j", "k").alias("j"), F.greatest("j", "k").alias("k"), r2.alias("r2"))
