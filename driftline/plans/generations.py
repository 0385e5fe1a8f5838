"""Generations as DataFrame steps: selection, meiosis and mutation, each generation cut from the last one's plan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import genetics
from driftline.functions.rng import uniform
from driftline.operators import reproduction, spatial, stats


def optimum(gen: int, shift_at: int | None, before: Column, after: Column) -> Column:
    """The optimum before a shift, and from it on."""
    return before if shift_at is None or gen < shift_at else after


def offspring(people: DataFrame, factor: float = 1.0) -> DataFrame:
    """child, deme: as many children in each deme as adults, times `factor` rounded down; it may not shrink."""
    if factor < 1:
        raise ValueError("a population may not shrink")
    # adults get numbers within demes side by side; the children of a number are a few rows
    numbered = people.select("ind_id", "deme").withColumn("_k", F.row_number().over(Window.partitionBy("deme").orderBy("ind_id")))
    copies = F.floor(F.col("_k") * factor) - F.floor((F.col("_k") - 1) * factor)
    return numbered.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select((F.col("ind_id") * int(factor + 1) + F.col("_i") - 1).alias("child"), "deme")


def next_generation(hap: DataFrame, variants: DataFrame, gen: int, *, seed: int, chr_len: int, vs: float, theta: Column | None = None, crossovers: float = 1.0, mutation: float = 0.0, neighbours: DataFrame | None = None, factor: float = 1.0) -> DataFrame:
    """Haplotypes of the next generation: hap_id, ind_id, deme, slot, allele.

    Each child draws two parents by fitness, each from a source deme; the same one twice is selfing. All draws are
    keyed by seed, generation and child, so partitions do not matter.
    """
    values = stats.breeding_values(hap, variants)
    fit = values.withColumn("w", genetics.gaussian_fitness(F.col("a"), theta if theta is not None else F.lit(0.0), F.lit(vs)))
    children = offspring(values, factor)
    sides = children.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("gamete", F.col("child") * 2 + F.col("side"))
    key = f"{seed}:{gen}"
    if neighbours is not None:
        sides = spatial.source_deme(sides, neighbours, uniform(key, "stay", F.col("gamete")), uniform(key, "pick", F.col("gamete")))
    else:
        sides = sides.withColumn("source", F.col("deme"))
    draws = sides.select(F.col("source").alias("deme"), F.col("gamete").alias("draw"), uniform(key, "parent", F.col("gamete")).alias("u"))
    parents = spatial.weighted_parent(draws, fit).select(F.col("draw").alias("gamete"), F.col("parent").alias("ind_id"))
    chromosomes = variants.select("chr").distinct()
    points = reproduction.breakpoints(parents, chromosomes, crossovers, chr_len, _seed(seed, gen))
    made = reproduction.gametes(parents, hap, variants, points, _seed(seed, gen)).withColumnRenamed("gamete", "hap_id")
    flipped = uniform(key, "mu", F.col("hap_id"), F.col("slot")) < mutation
    return made.join(children, F.floor(F.col("hap_id") / 2) == F.col("child")).select("hap_id", F.col("child").alias("ind_id"), "deme", "slot", F.when(flipped, 1 - F.col("allele")).otherwise(F.col("allele")).alias("allele"))


def _seed(seed: int, gen: int) -> int:
    return seed * 1_000_003 + gen


def run(spark: SparkSession, hap: DataFrame, variants: DataFrame, generations: int, path: str, **settings) -> Iterator[tuple[int, DataFrame]]:
    """Yields each generation's number and haplotypes; each is written under `path`, which all executors share."""
    for gen in range(1, generations + 1):
        out = f"{path}/gen={gen}"
        next_generation(hap, variants, gen, **settings).write.mode("overwrite").parquet(out)
        hap = spark.read.parquet(out)
        yield gen, hap


def trajectory_row(hap: DataFrame, variants: DataFrame, gen: int) -> DataFrame:
    """gen, b, va, mean_p, var_p: one generation's statistics, demes averaged."""
    demes = stats.bulmer_per_deme(hap, variants).agg(F.avg("b").alias("b"), F.avg("va").alias("va"))
    p = stats.allele_frequency(hap, variants).agg(F.avg("p").alias("mean_p"), F.var_samp("p").alias("var_p"))
    return demes.crossJoin(F.broadcast(p)).select(F.lit(gen).alias("gen"), "b", "va", "mean_p", "var_p")  # one row each
