"""Populations, genealogies, neutral panels and summaries as files: written by Spark, read back, checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _write(df: DataFrame, path: str, by: str | None = None) -> None:
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)


def write_snapshot(path: str, hap: DataFrame, variants: DataFrame) -> None:
    """Variants, haplotypes' individuals and demes, and carriers: haplotypes with the derived allele at a slot."""
    _write(variants, f"{path}/variants")
    _write(hap.select("hap_id", "ind_id", "deme").distinct(), f"{path}/haplotypes")
    _write(hap.where("allele = 1").join(variants.select("slot", "chr"), "slot").select("chr", "hap_id", "slot"), f"{path}/carriers", "chr")


def write_header(path: str, hap: DataFrame, variants: DataFrame, chr_len: int, grid: int) -> None:
    """What a snapshot holds, beside it: counts of haplotypes, individuals, sites, trait and active sites from the tables
    themselves, the side of the grid, and each chromosome's length and first and last slot. Demes are counted only on a grid.
    """
    carried = hap.where("allele = 1").select("slot").distinct().withColumn("_a", F.lit(1))
    sites = variants.join(carried, "slot", "left").agg(F.count(F.lit(1)).alias("sites"), F.count_if("is_qtl").alias("trait_sites"), F.count("_a").alias("active_sites"))
    people = hap.select("hap_id", "ind_id", "deme").distinct().agg(F.count(F.lit(1)).alias("haplotypes"), F.count_distinct("ind_id").alias("individuals"), (F.count_distinct("deme") if grid > 1 else F.lit(1)).alias("demes"))
    chromosomes = variants.groupBy("chr").agg(F.min("slot").alias("first"), F.max("slot").alias("last")).withColumn("length", F.lit(chr_len))
    _write(sites.crossJoin(people).withColumn("grid", F.lit(grid)), f"{path}/header")  # one row each
    _write(chromosomes, f"{path}/chromosomes")


def read_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The row of counts, which must be those of the stored tables, and the chromosomes."""
    header = spark.read.parquet(f"{path}/header")
    stored = spark.read.parquet(f"{path}/variants").agg(F.count(F.lit(1)).alias("_s")).crossJoin(spark.read.parquet(f"{path}/haplotypes").agg(F.count(F.lit(1)).alias("_h")))
    same = (F.col("sites") == F.col("_s")) & (F.col("haplotypes") == F.col("_h"))
    told = header.crossJoin(stored).withColumn("sites", F.when(same, F.col("sites")).otherwise(F.raise_error(F.lit("header and snapshot differ")).cast("long"))).drop("_s", "_h")  # one row each
    return told, spark.read.parquet(f"{path}/chromosomes")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variants with `active` (a slot is active if any haplotype carries it), haplotypes, and carriers (hap_id, slot)."""
    carriers = spark.read.parquet(f"{path}/carriers").select("hap_id", "slot")
    active = carriers.select("slot").distinct().withColumn("_active", F.lit(True))
    variants = spark.read.parquet(f"{path}/variants").join(active, "slot", "left").withColumn("active", F.coalesce("_active", F.lit(False))).drop("_active")
    return variants, spark.read.parquet(f"{path}/haplotypes"), carriers


def write_ancestry(path: str, edges: DataFrame, samples: DataFrame) -> None:
    """Edges by chromosome, and one row that tells how many nodes there are and the ids of samples, which have no gaps."""
    ids = samples.agg(F.min("node").alias("first_sample"), F.max("node").alias("last_sample"), F.count_distinct("node").alias("n_samples"))
    nodes = edges.select("parent").union(edges.select("child")).agg(F.count_distinct("parent").alias("n_nodes"))
    _write(edges, f"{path}/edges", "chr")
    _write(nodes.crossJoin(ids), f"{path}/nodes")  # one row each


def read_ancestry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges, and the row of counts; samples whose ids have gaps are an error."""
    whole = F.col("last_sample") - F.col("first_sample") + 1 == F.col("n_samples")
    nodes = spark.read.parquet(f"{path}/nodes").withColumn("n_samples", F.when(whole | (F.col("n_samples") == 0), F.col("n_samples")).otherwise(F.raise_error(F.lit("ids of samples have gaps")).cast("long")))
    return spark.read.parquet(f"{path}/edges"), nodes


def write_panel(path: str, mutations: DataFrame) -> None:
    """chr, node, bp of neutral mutations as one ordered list for each chromosome and node."""
    _write(mutations.groupBy("chr", "node").agg(F.sort_array(F.collect_set("bp")).alias("positions")), path, "chr")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("chr", "node", F.explode("positions").alias("bp"))


def write_summary(path: str, table: DataFrame, by: str) -> None:
    """A row for each value of `by` and column, as key (value.column) and value in a tab-separated file with a header.

    `table` has a row for each of few scopes, so that one file holds it. Columns that are no numbers are written as they
    are, nulls as nothing.
    """
    columns = [c for c in table.columns if c != by]
    long = table.select(by, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([by], columns, "_c", "value")
    rows = long.select(F.concat_ws(".", by, "_c").alias("key"), "value").coalesce(1).sortWithinPartitions("key")
    rows.write.option("sep", "\t").option("header", True).csv(path)


def write_keys(path: str, tables: dict[str, DataFrame], by: dict[str, str] | None = None) -> None:
    """Small tables as one file of key and value: `name.column` of a table of one row, or `name.value.column` for each value of
    its column in `by`; a name of no letters is left out. Nulls of numbers are written as NaN, of others as nothing.
    """
    rows = None
    for name, table in tables.items():
        one = (by or {}).get(name)
        columns = [c for c in table.columns if c != one]
        text = lambda c, kind: F.when(F.col(c).isNotNull(), F.col(c).cast("string")).otherwise("NaN" if kind in ("double", "float") else "")
        long = table.select(*([one] if one else []), *[text(c, kind).alias(c) for c, kind in table.dtypes if c != one]).unpivot([one] if one else [], columns, "_c", "value")
        part = long.select(F.concat_ws(".", *([F.lit(name)] if name else []), *([one] if one else []), "_c").alias("key"), "value")
        rows = part if rows is None else rows.unionByName(part)
    rows.coalesce(1).sortWithinPartitions("key").write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def read_summary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, key, value (text) of summaries; `source` is the last part of a path."""
    rows = spark.read.csv(paths, sep="\t", header=True, schema="key string, value string")
    return rows.select(F.element_at(F.split(F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1), "/"), -1).alias("source"), "key", "value")


def across_seeds(rows: DataFrame) -> DataFrame:
    """key, n, median over sources that have a number, and stars of keys that end in p: at .05, .01 and .001."""
    number = F.expr("try_cast(value AS DOUBLE)")
    found = rows.select("key", number.alias("v")).where("v is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.median("v").alias("median"))
    stars = F.when(F.col("median") < 0.001, "***").when(F.col("median") < 0.01, "**").when(F.col("median") < 0.05, "*").otherwise("")
    return found.withColumn("stars", F.when(F.col("key").rlike(r"_p$"), stars).otherwise(""))
