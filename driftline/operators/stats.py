"""Population statistics: frequencies, breeding values, genic and additive variance, Bulmer's factor, F_ST."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.genetics import bulmer


def allele_frequency(hap: DataFrame, variants: DataFrame) -> DataFrame:
    """slot, p: the share of haplotypes with the derived allele; 0 at sites that no row has."""
    copies = hap.groupBy("slot").agg((F.sum("allele") / F.count(F.lit(1))).alias("p"))
    return variants.select("slot").join(copies, "slot", "left").select("slot", F.coalesce("p", F.lit(0.0)).alias("p"))


def dosage(hap: DataFrame) -> DataFrame:
    """ind_id, deme, slot, g: copies of the derived allele."""
    return hap.groupBy("ind_id", "deme", "slot").agg(F.sum("allele").cast("int").alias("g"))


def breeding_values(hap: DataFrame, variants: DataFrame) -> DataFrame:
    """ind_id, deme, a: the sum of effects over both haplotypes; 0 for individuals without any trait allele."""
    effects = F.broadcast(variants.select("slot", F.when(F.col("is_qtl"), F.col("alpha")).otherwise(0.0).alias("_alpha")))  # one row a site
    return hap.join(effects, "slot").groupBy("ind_id", "deme").agg(F.sum(F.col("allele") * F.col("_alpha")).alias("a"))


def mean_and_variance(values: DataFrame, by: list[str] | None = None, column: str = "a") -> DataFrame:
    """n, mean and sample variance (0 for one row)."""
    return values.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.coalesce(F.nanvl(F.var_samp(column), F.lit(0.0)), F.lit(0.0)).alias("variance"))


def genic_variance(hap: DataFrame, variants: DataFrame, by: list[str] | None = None) -> DataFrame:
    """genic: the sum over trait sites of 2 p (1 - p) alpha**2, within each group of `by`."""
    by = by or []
    effects = F.broadcast(variants.where("is_qtl").select("slot", "alpha"))
    p = hap.groupBy(*by, "slot").agg(F.avg(F.col("allele").cast("double")).alias("p")).join(effects, "slot")
    return p.groupBy(*by).agg(F.sum(2 * F.col("p") * (1 - F.col("p")) * F.col("alpha") * F.col("alpha")).alias("genic"))


def bulmer_per_deme(hap: DataFrame, variants: DataFrame) -> DataFrame:
    """deme, n, va, genic, b: variance of breeding values against the genic variance of the same deme."""
    va = mean_and_variance(breeding_values(hap, variants), ["deme"]).withColumnRenamed("variance", "va").drop("mean")
    return va.join(genic_variance(hap, variants, ["deme"]), "deme").withColumn("b", bulmer(F.col("va"), F.col("genic")))


def final_summary(hap: DataFrame, variants: DataFrame, noise: Column) -> DataFrame:
    """One row of a population's end: mean_a, var_a, genic, b, var_pheno and h2 as averages over demes by their sizes, the
    same pooled (var_a_pooled, genic_pooled, b_pooled), n_polymorphic, and of trait sites that vary their number, the mean
    square of effects and their mean size. `noise` is an individual's environment, from ind_id; without individuals all
    is null or 0.
    """
    values = breeding_values(hap, variants)
    per = values.withColumn("_z", F.col("a") + noise).groupBy("deme").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("m"), F.coalesce(F.var_samp("a"), F.lit(0.0)).alias("va"), F.coalesce(F.var_samp("_z"), F.lit(0.0)).alias("vz"))
    per = per.join(genic_variance(hap, variants, ["deme"]), "deme").withColumn("b", bulmer(F.col("va"), F.col("genic")))
    over = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    demes = per.agg(over("m").alias("mean_a"), over("va").alias("var_a"), over("genic").alias("genic"), over("b").alias("b"), over("vz").alias("var_pheno")).withColumn("h2", F.when(F.col("var_pheno") > 0, F.col("var_a") / F.col("var_pheno")).otherwise(0.0))
    pooled = values.agg(F.var_samp("a").alias("var_a_pooled"))
    p = allele_frequency(hap, variants).join(variants.select("slot", "is_qtl", "alpha"), "slot")
    varies = (F.col("p") > 1e-12) & (F.col("p") < 1 - 1e-12)
    of = lambda value: F.coalesce(F.avg(F.when(varies & F.col("is_qtl"), value)), F.lit(0.0))
    sites = p.agg(
        F.sum(F.when(F.col("is_qtl"), 2 * F.col("p") * (1 - F.col("p")) * F.col("alpha") * F.col("alpha"))).alias("genic_pooled"), F.count_if(varies).alias("n_polymorphic"),
        F.count_if(varies & F.col("is_qtl")).alias("n_qtl_polymorphic"), of(F.col("alpha") * F.col("alpha")).alias("mean_alpha_sq"), of(F.abs("alpha")).alias("mean_abs_alpha"),
    )
    return demes.crossJoin(pooled).crossJoin(sites).withColumn("b_pooled", F.when(F.col("genic_pooled") > 0, (F.col("var_a_pooled") - F.col("genic_pooled")) / F.col("genic_pooled")).otherwise(0.0))  # one row each


def polymorphic_count(freq: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    return freq.agg(F.count_if((F.col("p") > tolerance) & (F.col("p") < 1 - tolerance)).alias("n_polymorphic"))


def fst(hap: DataFrame) -> DataFrame:
    """Sum of population variances of deme frequencies over the sum of p (1 - p) of their means."""
    p = hap.groupBy("slot", "deme").agg(F.avg(F.col("allele").cast("double")).alias("p"))
    site = p.groupBy("slot").agg(F.var_pop("p").alias("v"), F.avg("p").alias("m"))
    return site.agg((F.sum("v") / F.sum(F.col("m") * (1 - F.col("m")))).alias("fst"))


def convergence(series: DataFrame, by: list[str], last: int = 10, window: int = 20) -> DataFrame:
    """Mean and deviation of the last values, and the relative change between halves of a window before the end.

    The change is null for a window of under four values, or when its first half has mean 0.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("gen"))
    back = series.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= window)
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    back = back.withColumn("_n", size)
    new = F.avg(F.when(F.col("_k") <= F.floor(F.col("_n") / 2), F.col("value")))
    old = F.avg(F.when(F.col("_k") > F.floor(F.col("_n") / 2), F.col("value")))
    out = back.groupBy(*by).agg(F.avg(F.when(F.col("_k") <= last, F.col("value"))).alias("tail_mean"), F.stddev_samp(F.when(F.col("_k") <= last, F.col("value"))).alias("tail_sd"), new.alias("_new"), old.alias("_old"), F.max("_n").alias("_n"))
    return out.select(*by, "tail_mean", "tail_sd", F.when((F.col("_n") >= 4) & (F.col("_old") != 0), (F.col("_new") - F.col("_old")) / F.abs("_old")).alias("half_change"))
