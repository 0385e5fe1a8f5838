"""The initial state of a population: sites on chromosomes, which of them are trait sites, effects and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.rng import exponential, normal, sign, uniform

#: Pairs of uniform draws that a Beta draw tries; that none is accepted is an error.
ATTEMPTS = 64


def place_sites(sites: DataFrame, chromosomes: int, chr_len: int, seed: int, write, rounds: int | None = None) -> DataFrame:
    """site, chr, bp: a uniform chromosome for each site, and a position on it that no other site has.

    In each round sites without a place draw a position; it goes to the least of those that draw it if it is free, the
    others draw again: rejection, hence uniform without replacement. More sites on a chromosome than positions are an
    error. `write(df, name)` cuts lineage. Null and repeated sites are left out. Rounds grow with the logarithm of the
    count of sites as long as most positions are free.

    With `rounds` drawing ends after so many: sites that no round placed are not in the result, and a chromosome may have
    more sites than positions.
    """
    left = sites.where("site is not null").select("site").distinct().withColumn("chr", (1 + F.floor(uniform(seed, "c", F.col("site")) * chromosomes)).cast("int"))
    left = write(left, "unplaced0")
    most = left.groupBy("chr").count().agg(F.max("count").alias("n")).first()["n"] or 0  # one number
    if rounds is None and most > chr_len:
        raise ValueError(f"{most} sites on a chromosome of {chr_len} positions")
    placed, k = None, 0
    while placed is None or (k != rounds and left.limit(1).count()):
        drawn = left.withColumn("bp", (1 + F.floor(uniform(seed, f"b{k}", F.col("site")) * chr_len)).cast("int"))
        if placed is not None:
            drawn = drawn.join(placed.select("chr", "bp"), ["chr", "bp"], "left_anti")
        won = drawn.groupBy("chr", "bp").agg(F.min("site").alias("site")).select("site", "chr", "bp")
        placed = write(won if placed is None else placed.unionByName(won), f"placed{k}")
        k += 1
        left = write(left.join(placed.select("site"), "site", "left_anti"), f"unplaced{k}")
    return placed


def choose(sites: DataFrame, n: int, seed: int) -> DataFrame:
    """The sites with `chosen`: true for n of them, drawn without replacement (all of them if there are fewer)."""
    drawn = sites.select("site").withColumn("_u", uniform(seed, "q", F.col("site"))).orderBy("_u", "site").limit(n).select("site", F.lit(True).alias("_in"))
    return sites.join(drawn, "site", "left").withColumn("chosen", F.coalesce("_in", F.lit(False))).drop("_in")


def effects(kind: str, key: Column, seed: int, scale: float) -> Column:
    """Effects by kind: exponential or fixed sizes with even signs, or normal ones."""
    if kind == "exponential":
        return exponential(uniform(seed, "e", key), scale) * sign(seed, "s", key)
    if kind == "normal":
        return normal(uniform(seed, "n1", key), uniform(seed, "n2", key), scale)
    if kind == "fixed":
        return sign(seed, "s", key) * scale
    raise ValueError(f"no kind of effects: {kind}")


def beta(a: float, b: float, key: Column, seed: int, maf_min: float = 0.0) -> Column:
    """A Beta(a, b) draw with at least that minor frequency: of pairs u ** (1 / a), v ** (1 / b) the first that sums to at
    most 1 gives x / (x + y).

    Half of the pairs or more are accepted if a and b are at most 1, as for mutation rates below one a site; for larger
    ones chances fall, and when no attempt is accepted there is an error. With a = b = 0 the draw is a half.
    """
    if a == 0 and b == 0:
        return F.lit(0.5)
    tries = F.transform(
        F.sequence(F.lit(1), F.lit(ATTEMPTS)),
        lambda i: F.struct(F.pow(uniform(seed, "x", key, i), F.lit(1 / a)).alias("x"), F.pow(uniform(seed, "y", key, i), F.lit(1 / b)).alias("y")),
    )
    fit = F.filter(F.transform(F.filter(tries, lambda t: (t["x"] + t["y"] <= 1) & (t["x"] + t["y"] > 0)), lambda t: t["x"] / (t["x"] + t["y"])), lambda p: F.least(p, 1 - p) >= maf_min)
    return F.coalesce(F.get(fit, F.lit(0)), F.raise_error(F.lit("no Beta draw was accepted")).cast("double"))


def frequency(kind: str, key: Column, seed: int, maf_min: float = 0.0, theta: float = 0.0, back: float | None = None, p: float = 0.5) -> Column:
    """First frequencies by kind, with at least that minor frequency.

    `beta`: Beta(theta, theta), a half for theta 0; `beta_asymmetric`: Beta(theta, back), the forward and backward rates
    scaled by 4 Ne; `uniform`: even between the least frequencies; `fixed`: p for all, an error if it is too rare. An
    empirical spectrum has no source here and is an error, as are other kinds.
    """
    if kind == "beta":
        return beta(theta, theta, key, seed, maf_min)
    if kind == "beta_asymmetric":
        return beta(theta, theta if back is None else back, key, seed, maf_min)
    if kind == "uniform":
        return maf_min + uniform(seed, "u", key) * (1 - 2 * maf_min)
    if kind == "fixed":
        if not 0 <= p <= 1 or (maf_min > 0 and min(p, 1 - p) < maf_min):
            raise ValueError(f"frequency {p} is not allowed with a least one of {maf_min}")
        return F.lit(float(p))
    raise ValueError(f"no source of frequencies: {kind}")


def chromosome_ranges(variants: DataFrame, n_chr: int) -> DataFrame:
    """chr, first, last, n_sites, n_qtl for chromosomes 1 to n_chr; 0 and -1 where one has no site."""
    found = variants.groupBy("chr").agg(F.min("slot").alias("_f"), F.max("slot").alias("_l"), F.count(F.lit(1)).alias("_n"), F.count_if("is_qtl").alias("_q"))
    every = variants.sparkSession.range(1, n_chr + 1).select(F.col("id").cast("int").alias("chr"))
    none = lambda c, v: F.coalesce(c, F.lit(v)).cast("long")
    return every.join(found, "chr", "left").select("chr", none(F.col("_f"), 0).alias("first"), none(F.col("_l"), -1).alias("last"), none(F.col("_n"), 0).alias("n_sites"), none(F.col("_q"), 0).alias("n_qtl"))
