"""PLINK 1 text and binary tables: codes, bim, fam and effects files, and SNP-major genotype bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: first bytes of a .bed file, and two-bit codes of 0, 1, 2 copies and of a missing call.
MAGIC = bytes([0x6C, 0x1B, 0x01])
CODES = {0: 0b11, 1: 0b10, 2: 0b00, -1: 0b01}


def code(g: Column) -> Column:
    """The two-bit code of a dosage; another value is an error."""
    out = F.lit(None).cast("int")
    for copies, bits in CODES.items():
        out = F.when(g == copies, bits).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("no dosage: "), g.cast("string"))).cast("int"))


def dosage_of(bits: Column) -> Column:
    out = F.lit(None).cast("int")
    for copies, c in CODES.items():
        out = F.when(bits == c, copies).otherwise(out)
    return out


def site_name(variants: DataFrame) -> Column:
    """chr{chr}_{bp}, with _{tag} where the variants have a tag."""
    return F.concat_ws("_", F.concat(F.lit("chr"), F.col("chr")), F.col("bp"), *(["tag"] if "tag" in variants.columns else []))


def bim(variants: DataFrame, recombination: float, keep: list[str] | None = None) -> DataFrame:
    """One tab-separated line for each variant, with its chr and bp or the columns to keep: chr, name, cM, bp, the derived allele and the other."""
    cm = F.format_string("%.6f", F.col("bp") * recombination * 100)
    return variants.select(*(keep or ["chr", "bp"]), F.concat_ws("\t", "chr", site_name(variants), cm, "bp", F.lit("1"), F.lit("0")).alias("line"))


def fam(people: DataFrame, phenotype: str = "a", keep: list[str] | None = None) -> DataFrame:
    """One line for each individual: family p{deme}, name p{deme}_{individual}, phenotype."""
    return people.select(*(keep or ["ind_id"]), F.concat_ws(" ", F.concat(F.lit("p"), "deme"), F.concat(F.lit("p"), "deme", F.lit("_"), "ind_id"), F.lit("0 0 0"), F.format_string("%.6f", F.col(phenotype))).alias("line"))


def parse_fam(lines: DataFrame, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """iid, deme, phenotype of fam lines, with the columns to keep; deme is null where the name does not tell it. Blank lines are left out."""
    parts = F.split(F.trim(column), r"\s+")
    rows = lines.where(F.trim(column) != "").select(*keep, F.get(parts, F.lit(1)).alias("iid"), F.get(parts, F.lit(5)).cast("double").alias("phenotype"))
    return rows.select(*keep, "iid", F.expr(r"try_cast(regexp_extract(iid, '^p([0-9]+)_([0-9]+)$', 1) AS INT)").alias("deme"), "phenotype")
