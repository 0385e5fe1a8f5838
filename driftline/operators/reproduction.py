"""Meiosis and mutation on long haplotype tables: crossovers, gametes, edges, recurrent and new mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.rng import poisson, uniform
from driftline.operators import ranges


def breakpoints(gametes: DataFrame, chromosomes: DataFrame, crossovers: float, chr_len: int, seed: int) -> DataFrame:
    """gamete, chr, bp: a Poisson number of crossovers for each gamete and chromosome, uniform along it."""
    each = gametes.select("gamete").crossJoin(F.broadcast(chromosomes.select("chr")))  # a row a chromosome
    k = poisson(uniform(seed, "k", F.col("gamete"), F.col("chr")), crossovers)
    drawn = each.withColumn("_k", k).where("_k > 0").select("gamete", "chr", F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("i"))
    return drawn.select("gamete", "chr", (1 + F.floor(uniform(seed, "bp", F.col("gamete"), F.col("chr"), F.col("i")) * chr_len)).cast("int").alias("bp"))


def to_slots(points: DataFrame, variants: DataFrame) -> DataFrame:
    """gamete, chr, bp, slot: the first variant at or after each crossover; null past the last one.

    An as-of join by one sort: variants and crossovers of a chromosome in order of position, each crossover taking the
    next variant.
    """
    a = variants.select("chr", "bp", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("gamete"), F.col("slot").cast("long").alias("_slot"))
    b = points.select("chr", "bp", F.lit(0).alias("_kind"), F.col("gamete").cast("long"), F.lit(None).cast("long").alias("_slot"))
    return ranges.next_known(a.union(b), ["chr"], ["bp", "_kind", "_slot"], "_slot", "slot").where("_kind = 0").select("gamete", "chr", "bp", "slot")


def gametes(parents: DataFrame, hap: DataFrame, variants: DataFrame, points: DataFrame, seed: int) -> DataFrame:
    """gamete, slot, allele: what each gamete of a parent (gamete, ind_id) carries.

    It starts on a strand drawn for each chromosome and changes at every crossover up to the site: strand = start +
    number of crossovers at or before it, modulo 2.
    """
    sites = variants.select("slot", "chr", "bp")
    start = F.floor(uniform(seed, "start", F.col("gamete"), F.col("chr")) * 2)
    cells = parents.crossJoin(F.broadcast(sites)).select("gamete", "ind_id", "chr", "bp", "slot", F.lit(0).alias("_cut"))  # one panel of variants
    cuts = points.join(parents, "gamete").select("gamete", "ind_id", "chr", "bp", F.lit(None).cast("int").alias("slot"), F.lit(1).alias("_cut"))
    w = Window.partitionBy("gamete", "chr").orderBy("bp", F.desc("_cut")).rowsBetween(Window.unboundedPreceding, 0)
    strands = cells.unionByName(cuts).withColumn("_n", F.sum("_cut").over(w)).where("_cut = 0").withColumn("strand", F.pmod(start + F.col("_n"), F.lit(2)).cast("int"))
    own = hap.select("ind_id", "slot", F.pmod("hap_id", F.lit(2)).cast("int").alias("strand"), "allele")
    return strands.join(own, ["ind_id", "slot", "strand"]).select("gamete", "slot", "allele")


def edge_segments(gametes: DataFrame, chromosomes: DataFrame, points: DataFrame, chr_len: int, seed: int) -> DataFrame:
    """gamete, chr, left, right, strand: half-open stretches between crossovers, the whole chromosome where there is none.

    Crossovers at one place leave an empty stretch out and change the strand unseen.
    """
    w = Window.partitionBy("gamete", "chr").orderBy("bp", "_i")
    every = gametes.select("gamete").crossJoin(F.broadcast(chromosomes.select("chr")))  # a row a chromosome
    ends = points.select("gamete", "chr", "bp").union(every.select("gamete", "chr", F.lit(1)))
    ends = ends.withColumn("_i", F.row_number().over(Window.partitionBy("gamete", "chr").orderBy("bp")))
    cut = ends.withColumn("right", F.lead("bp", 1, chr_len + 1).over(w))
    start = F.floor(uniform(seed, "start", F.col("gamete"), F.col("chr")) * 2)
    return cut.where("bp < right").select("gamete", "chr", F.col("bp").alias("left"), "right", F.pmod(start + F.col("_i") - 1, F.lit(2)).cast("int").alias("strand"))


def edges_at_variants(gametes: DataFrame, variants: DataFrame, points: DataFrame, chr_len: int, seed: int) -> DataFrame:
    """gamete, chr, left, right, strand: half-open stretches cut at the first variant at or after each crossover.

    Crossovers that take effect at one variant cut once and change the strand as often as they are; those past the last
    variant cut nothing, and the last stretch reaches the chromosome's end. An as-of join by ranges of positions.
    """
    placed = variants.select("slot", F.col("bp").alias("_at"))
    cuts = to_slots(points, variants).where("slot is not null").join(placed, "slot").groupBy("gamete", "chr", F.col("_at").alias("bp")).agg(F.count(F.lit(1)).alias("_n"))
    every = gametes.select("gamete").crossJoin(F.broadcast(variants.select("chr").distinct()))  # a row a chromosome
    # a cut at place 1 leaves no stretch before it but changes the strand
    ends = cuts.unionByName(every.select("gamete", "chr", F.lit(1).alias("bp"), F.lit(0).cast("long").alias("_n"))).groupBy("gamete", "chr", "bp").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy("gamete", "chr").orderBy("bp")
    start = F.floor(uniform(seed, "start", F.col("gamete"), F.col("chr")) * 2)
    turned = ends.withColumn("right", F.lead("bp", 1, chr_len + 1).over(w)).withColumn("_t", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return turned.select("gamete", "chr", F.col("bp").alias("left"), "right", F.pmod(start + F.col("_t"), F.lit(2)).cast("int").alias("strand"))


def flip(carriers: DataFrame, mutations: DataFrame) -> DataFrame:
    """Recurrent mutation: (hap_id, slot) cells that are in one of the two tables and not in both."""
    cells = carriers.select("hap_id", "slot").union(mutations.select("hap_id", "slot").distinct())
    return cells.groupBy("hap_id", "slot").count().where(F.col("count") % 2 == 1).select("hap_id", "slot")


def mutated_cells(hap: DataFrame, rate: float, seed: int) -> DataFrame:
    """Cells that mutate: each one with the same chance."""
    return hap.where(uniform(seed, "mu", F.col("hap_id"), F.col("slot")) < rate).select("hap_id", "slot")


def free_slots(slots: DataFrame, active: DataFrame, need: DataFrame) -> DataFrame:
    """chr, slot, mutation: the lowest free slots of each chromosome for as many new mutations as `need` (chr, n) says.

    A chromosome with fewer free slots is an error.
    """
    open_ = slots.join(active.select("slot").distinct(), "slot", "left_anti")
    free = open_.groupBy("chr").agg(F.count(F.lit(1)).alias("_free"))
    lack = F.raise_error(F.concat(F.lit("no free slots left on chromosome "), F.col("chr").cast("string")))
    wanted = need.join(free, "chr", "left").select("chr", F.when(F.coalesce("_free", F.lit(0)) < F.col("n"), lack.cast("long")).otherwise(F.col("n")).alias("n"))  # a row a chromosome
    numbered = open_.withColumn("mutation", F.row_number().over(Window.partitionBy("chr").orderBy("slot")))
    return numbered.join(F.broadcast(wanted), "chr").where("mutation <= n").select("chr", "slot", "mutation")


def cleanup(slots: DataFrame, carriers: DataFrame, n_hap: int) -> DataFrame:
    """slot, state: lost (no carrier), fixed (all carry) or segregating."""
    counted = carriers.groupBy("slot").agg(F.countDistinct("hap_id").alias("_n"))
    state = F.when(F.col("_n").isNull(), "lost").when(F.col("_n") >= n_hap, "fixed").otherwise("segregating")
    return slots.select("slot").join(counted, "slot", "left").select("slot", F.coalesce("_n", F.lit(0)).alias("carriers"), state.alias("state"))
