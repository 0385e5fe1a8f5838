"""Mutation by number: how many is one exact draw, which is a keyed permutation; tables of slots for new and first sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.draws import binomial_count, keyed_uniform, permuted, poisson_count
from driftline.functions.genetics import watterson_frequency
from driftline.functions.rng import uniform
from driftline.operators.initial import effects
from driftline.operators.ranges import in_order


def mutated_cells(haps: DataFrame, sites: DataFrame, rate: float, seed: int, pool: str, write) -> DataFrame:
    """hap_id, slot of the cells that mutate, each with chance `rate`: a Binomial number of the haplotypes times `sites`.

    Cells are numbered by haplotype, then site; the mutated ones are the first places of a permutation of all cells, so work
    grows with the mutations and no cell is looked at. Haplotypes and slots are numbered by ranges. `pool` keeps the draws
    of two pools of sites apart. Repeated haplotypes or sites count once; empty tables give none.
    """
    cols = write(in_order(haps.select("hap_id").distinct(), ["hap_id"], "_col"), f"columns_{pool}")
    rows = write(in_order(sites.select("slot").distinct(), ["slot"], "_row"), f"rows_{pool}")
    width = rows.count()
    cells = width * cols.count()
    count = binomial_count(keyed_uniform(seed, pool, "m"), cells, rate)
    place = permuted(F.col("id"), max(cells, 1), seed, pool)
    drawn = haps.sparkSession.range(count).select(place.alias("_cell")).withColumn("_col", F.floor(F.col("_cell") / max(width, 1))).withColumn("_row", F.pmod("_cell", F.lit(max(width, 1))))
    return drawn.join(cols, "_col").join(rows, "_row").select("hap_id", "slot")


def new_mutations(free: DataFrame, copies: int, trait_rate: float, neutral_rate: float, kind: str, scale: float, seed: int) -> DataFrame:
    """slot, hap (0 to copies - 1), is_qtl, alpha: the new sites of a generation, one carrier each, as a delta table.

    A Poisson number for each class; trait sites take the lowest free slots, neutral ones those after them, by the slots'
    numbers in ranges. More mutations than free slots are an error. Carriers are drawn with replacement. Effects are
    drawn by slot, apart from carriers.
    """
    trait = poisson_count(keyed_uniform(seed, "trait"), copies * trait_rate)
    made = trait + poisson_count(keyed_uniform(seed, "neutral"), copies * neutral_rate)
    numbered = in_order(free.select("slot").distinct(), ["slot"], "_k")
    taken = numbered.where(F.col("_k") < made)
    room = taken.agg(F.count(F.lit(1)).alias("n")).first()["n"]  # one number
    if room < made:
        raise ValueError(f"{made} new mutations and {room} free slots: the capacity of slots is too small")
    own = F.col("_k") < trait
    hap = F.floor(uniform(seed, "hap", F.col("_k")) * copies).cast("long")
    return taken.select("slot", hap.alias("hap"), own.alias("is_qtl"), F.when(own, effects(kind, F.col("slot"), seed, scale)).otherwise(0.0).alias("alpha"))


def apply_mutations(variants: DataFrame, carriers: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants (slot, chr, bp, is_qtl, alpha, active) and carriers (slot, hap) after `made` is merged into them.

    A slot that was free gets its new class and effect; carriers it has left from before are an error of the caller's.
    """
    new = made.select("slot", F.col("is_qtl").alias("_q"), F.col("alpha").alias("_a"))
    hit = F.col("_q").isNotNull()
    joined = variants.join(new, "slot", "left")
    after = joined.select("slot", "chr", "bp", F.when(hit, F.col("_q")).otherwise(F.col("is_qtl")).alias("is_qtl"), F.when(hit, F.col("_a")).otherwise(F.col("alpha")).alias("alpha"), (hit | F.col("active")).alias("active"))
    return after, carriers.select("slot", "hap").unionByName(made.select("slot", "hap"))


def _chosen(n: int, k: int, seed: int, label: str) -> Column:
    """Whether a slot with number `_k` of n is among k drawn without replacement: its place in a permutation is below k."""
    return permuted(F.col("_k"), max(n, 1), seed, label) < k


def ism_initial(slots: DataFrame, copies: int, trait_rate: float, neutral_rate: float, expected: float, kind: str, scale: float, seed: int, denovo: bool = False) -> DataFrame:
    """slot, chr, bp, active, is_qtl, alpha, p: the first table of slots under infinite sites.

    A Poisson number of sites of mean `expected`, at most the capacity, is active, drawn without replacement; a Binomial
    number of these by the classes' rates are trait sites, with effects. Active sites have a frequency of the neutral
    spectrum of `copies` haplotypes; the other slots are free: no effect, frequency 0. De novo, or without rates, all are.
    Numbers come by ranges of slots and draws by place, so no task holds all slots.
    """
    rate = trait_rate + neutral_rate
    numbered = in_order(slots.select("slot", "chr", "bp"), ["slot"], "_k")
    n = slots.count()
    some = 0 if denovo or rate <= 0 else min(n, poisson_count(keyed_uniform(seed, "sites"), expected))
    trait = binomial_count(keyed_uniform(seed, "traits"), some, trait_rate / rate) if some else 0
    place = permuted(F.col("_k"), max(n, 1), seed, "active")
    # the first places of one permutation: trait sites are those before the others, so they are a draw of their own
    drawn = numbered.withColumn("_place", place).withColumn("active", F.col("_place") < some).withColumn("is_qtl", F.col("_place") < trait)
    return drawn.select(
        "slot", "chr", "bp", "active", "is_qtl", F.when(F.col("is_qtl"), effects(kind, F.col("slot"), seed, scale)).otherwise(0.0).alias("alpha"),
        F.when(F.col("active"), watterson_frequency(uniform(seed, "w", F.col("slot")), F.lit(float(copies)))).otherwise(0.0).alias("p"),
    )


def recap_sites(slots: DataFrame, trait_sites: int, kind: str, scale: float, seed: int, infinite: bool) -> DataFrame:
    """slot, chr, bp, is_qtl, alpha, active before sites are placed on a genealogy: exactly `trait_sites` trait sites.

    Under infinite sites only these are active and the other slots are free; else all are active. More trait sites than
    slots are an error.
    """
    numbered = in_order(slots.select("slot", "chr", "bp"), ["slot"], "_k")
    n = slots.count()
    if trait_sites > n:
        raise ValueError(f"{trait_sites} trait sites and {n} slots")
    drawn = numbered.withColumn("is_qtl", _chosen(n, trait_sites, seed, "recap"))
    return drawn.select("slot", "chr", "bp", "is_qtl", F.when(F.col("is_qtl"), effects(kind, F.col("slot"), seed, scale)).otherwise(0.0).alias("alpha"), (F.col("is_qtl") if infinite else F.lit(True)).alias("active"))
