"""PLINK bundles as files: genotypes, sites, individuals and effects of a population, written by tasks and read back.

A bundle is `prefix.bed` or `prefix.bed.zst`, `prefix.bim`, `prefix.fam` and `prefix.effects.tsv`, each one file that tasks
write together.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.rng import uniform
from driftline.operators.ranges import in_order
from driftline.sources.plink import bim, fam, parse_fam, site_name
from driftline.sources.plink_format import has_file, read_genotypes, write_bed, write_frames
from driftline.sources.whole_file import write_lines

# Fixed value: the first line of a file of effects.
EFFECTS_HEAD = "snp_id\tchr\tbp\tis_qtl\talpha"


def write_bundle(prefix: str, geno: DataFrame, sites: DataFrame, people: DataFrame, recombination: float, write, compressed: bool = False) -> None:
    """Writes ind_id, slot, g (absent cells have no copies), slot, chr, bp, alpha, is_qtl and ind_id, deme, a as one bundle.

    Sites are in order of (chr, bp, slot), or of `rank` after (chr, bp) if they have one, individuals of (deme, ind_id); a
    site's `tag` ends its name. A dosage that is not 0, 1, 2 or -1 (missing) is an error. `prefix` is in a folder that all
    machines share. A task packs whole sites: what it holds at once grows with the individuals only. `write(df, name)` cuts
    lineage of the places. A .bed has two bits for each individual and site; with `compressed` it is a .bed.zst, whose
    frames are small where few individuals have copies.
    """
    ranked = sites if "rank" in sites.columns else sites.withColumn("rank", F.col("slot"))
    places = write(in_order(ranked, ["chr", "bp", "rank"], "row"), "sites")
    columns = write(in_order(people, ["deme", "ind_id"], "col"), "people")
    n = columns.count()
    write_lines(bim(places, recombination, ["row"]), ["row"], F.col("line"), f"{prefix}.bim")
    write_lines(fam(columns, keep=["col"]), ["col"], F.col("line"), f"{prefix}.fam")
    tab = F.concat_ws("\t", site_name(places), "chr", "bp", F.col("is_qtl").cast("int"), "alpha")
    write_lines(places, ["row"], tab, f"{prefix}.effects.tsv", EFFECTS_HEAD)
    known = geno.join(places.select("slot", "row"), "slot").join(columns.select("ind_id", "col"), "ind_id").select("row", "col", "g")
    if compressed:
        write_frames(known, places.count(), n, f"{prefix}.bed.zst", write)
    else:
        write_bed(known, places.count(), n, f"{prefix}.bed")


def write_merged(prefix: str, trait: DataFrame, carriers: DataFrame, neutral: DataFrame, people: DataFrame, owner, recombination: float, write, compressed: bool = False) -> None:
    """Trait sites and neutral mutations of the same haplotypes as one bundle.

    `trait` (slot, chr, bp, alpha, is_qtl) are active sites, of which trait sites count, with `carriers` (slot, hap_id);
    `neutral` has chr, bp, hap_id, a list for each haplotype in any order with repeats; `owner(hap_id)` is its individual.
    Sites of both kinds come in order of (chr, bp); at one place trait sites come first and both stay, named _q and _n.
    A site's carriers meet by their keys on both sides, so no list of a haplotype or of a site is put together before the
    site's row is packed.
    """
    own = trait.where("is_qtl").select(F.concat(F.lit("q"), F.col("slot")).alias("slot"), "chr", "bp", "alpha", F.lit(True).alias("is_qtl"), F.lit("q").alias("tag"), F.col("slot").cast("long").alias("rank"))
    cells = neutral.select("chr", "bp", "hap_id").distinct().withColumn("slot", F.concat_ws("_", F.lit("n"), "chr", "bp"))
    other = cells.groupBy("slot", "chr", "bp").agg(F.lit(0.0).alias("alpha"), F.lit(False).alias("is_qtl"), F.lit("n").alias("tag"), F.lit(2**62).alias("rank"))
    both = cells.select("slot", "hap_id").unionByName(carriers.select(F.concat(F.lit("q"), F.col("slot")).alias("slot"), "hap_id").join(own.select("slot"), "slot", "left_semi"))
    geno = both.groupBy("slot", owner(F.col("hap_id")).alias("ind_id")).agg(F.count(F.lit(1)).cast("int").alias("g"))
    write_bundle(prefix, geno, own.unionByName(other), people, recombination, write, compressed)


def read_lines(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """place, line: lines of a text file, or of a folder of parts in the order of their names, without blank ones and headers."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i")).where(F.trim("value") != "")
    kept = rows if header is None else rows.where(F.col("value") != header)
    return in_order(kept, ["_f", "_s", "_i"], "place").select("place", F.col("value").alias("line"))


def read_sites(spark: SparkSession, prefix: str) -> DataFrame:
    """place, chr, snp_id, cm, bp of the sites' lines, split at any white space."""
    f = F.split(F.trim("line"), r"\s+")
    at = lambda k, kind: F.get(f, F.lit(k)).cast(kind)
    return read_lines(spark, f"{prefix}.bim").select("place", at(0, "int").alias("chr"), at(1, "string").alias("snp_id"), at(2, "double").alias("cm"), at(3, "int").alias("bp"))


def read_people(spark: SparkSession, prefix: str) -> DataFrame:
    """place, iid, deme, phenotype; where one name does not tell its deme, all individuals are of deme 1."""
    people = parse_fam(read_lines(spark, f"{prefix}.fam"), keep=("place",))
    all_told = people.agg(F.coalesce(F.bool_and(F.col("deme").isNotNull()), F.lit(True)).alias("_told"))
    return people.crossJoin(F.broadcast(all_told)).select("place", "iid", F.when(F.col("_told"), F.col("deme")).otherwise(1).alias("deme"), "phenotype")  # one row


def read_effects(spark: SparkSession, prefix: str, effects: DataFrame | None = None) -> DataFrame:
    """place, snp_id, chr, bp, is_qtl, alpha: the sites with their effects.

    Effects are those given (place, alpha; a site with an effect other than 0 is a trait site), else those of the file,
    line by line, else there is a warning and all sites are neutral. Another count of effects than sites is an error, as
    is a line of another place than its site's.
    """
    sites = read_sites(spark, prefix).select("place", "snp_id", "chr", "bp")
    differ = F.raise_error(F.lit("effects and sites differ"))
    if effects is not None:
        given = effects.select("place", F.col("alpha").cast("double").alias("alpha"), F.lit(True).alias("_given"))
        both = sites.join(given, "place", "full").withColumn("alpha", F.when(F.col("_given") & F.col("snp_id").isNotNull(), F.col("alpha")).otherwise(differ.cast("double")))
        return both.select("place", "snp_id", "chr", "bp", (F.col("alpha") != 0).alias("is_qtl"), "alpha")
    if not has_file(spark, f"{prefix}.effects.tsv"):
        warnings.warn(f"no effects are given and {prefix}.effects.tsv is not there: all sites are neutral", stacklevel=2)
        return sites.withColumns({"is_qtl": F.lit(False), "alpha": F.lit(0.0)})
    f = F.split("line", "\t")
    rows = read_lines(spark, f"{prefix}.effects.tsv", EFFECTS_HEAD)
    lines = rows.select("place", F.get(f, F.lit(1)).cast("int").alias("_chr"), F.get(f, F.lit(2)).cast("int").alias("_bp"), F.get(f, F.lit(3)).cast("int").alias("_q"), F.get(f, F.lit(4)).cast("double").alias("alpha"))
    same = (F.col("chr") == F.col("_chr")) & (F.col("bp") == F.col("_bp"))
    both = sites.join(lines, "place", "full").withColumn("is_qtl", F.when(same, F.col("_q") == 1).otherwise(differ.cast("boolean")))
    return both.select("place", "snp_id", "chr", "bp", "is_qtl", "alpha")


class Bundle(NamedTuple):
    """A loaded bundle: sites (place, snp_id, chr, bp, is_qtl, alpha, active), people (place, iid, deme, phenotype), cells of
    its haplotypes (row, col, copy) and the side of the grid of demes (1: all individuals mix)."""

    sites: DataFrame
    people: DataFrame
    carriers: DataFrame
    grid: int


def load_bundle(spark: SparkSession, prefix: str, seed: int, grid: bool = False, effects: DataFrame | None = None) -> Bundle:
    """Loads a bundle as a population: every site is active and every heterozygote gets a phase of its own draw.

    With `grid` the demes in the names lie on a square; where a name tells none, or their number is no square, there is a
    warning and all individuals are of deme 1. Else demes play no part. A missing call is an error.
    """
    people = parse_fam(read_lines(spark, f"{prefix}.fam"), keep=("place",))
    told = people.agg(F.count(F.lit(1)).alias("n"), F.count("deme").alias("named"), F.countDistinct("deme").alias("demes")).first()  # one row
    side, n = math.isqrt(told["demes"]), told["n"]
    square = grid and told["named"] == n > 0 and side * side == told["demes"]
    if grid and not square:
        warnings.warn(f"{told['named']} of {n} names tell a deme, {told['demes']} demes in all, which is no grid: all individuals mix", stacklevel=2)
    people = people.withColumn("deme", F.col("deme") if square else F.lit(1))
    carriers = phased(read_genotypes(spark, prefix, n), uniform(seed, "phase", F.col("row"), F.col("col")))
    return Bundle(read_effects(spark, prefix, effects).withColumn("active", F.lit(True)), people, carriers, side if square else 1)


def phased(cells: DataFrame, draw) -> DataFrame:
    """row, col, copy of derived alleles: both copies of a 2, and of a 1 the copy that `draw` picks (0 below a half)."""
    which = F.when(F.col("g") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(draw < 0.5, 0).otherwise(1)))
    return cells.select("row", "col", F.explode(which).alias("copy"))
