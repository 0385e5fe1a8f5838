"""Population relations over the stored tables: haplotypes, variants, dosages, edges and a trajectory.

`embeddings` are read as phased haplotypes: a row is one haplotype, a dimension one locus, a positive number the derived
allele; two neighbouring rows are an individual. `orders` with `lineitem` are read as sparse dosages: a customer is an
individual, a part a locus, its nation a deme. Loci are numbered from 1, parts from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCI = 64
CHROMOSOMES = 4
CHR_LEN = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _site(slot: Column, loci: Column) -> list[Column]:
    effect = ((slot * 104729) % 2001 - 1000) / 10000.0
    return [
        (1 + F.floor((slot - 1) / F.ceil(loci / CHROMOSOMES))).cast("int").alias("chr"),
        (1 + (slot * 7919) % CHR_LEN).cast("int").alias("bp"),
        F.when(effect == 0, 0.0001).otherwise(effect).alias("alpha"),
        (slot % 8 != 0).alias("is_qtl"),
    ]


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, chr, bp, alpha, is_qtl: one row for each dimension of `embeddings`."""
    size = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("loci"))
    slots = size.select("loci", F.explode(F.sequence(F.lit(1), F.col("loci"))).alias("slot"))
    return slots.select("slot", *_site(F.col("slot").cast("long"), F.col("loci")))


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hap_id, ind_id, deme, slot, allele: one row for each haplotype and locus."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hap_id"), F.floor(F.col("vec_id") / 2).alias("ind_id"), "label", "embedding")
    first = rows.where("hap_id % 2 = 0").select("ind_id", F.col("label").alias("deme"))
    return rows.join(first, "ind_id").select("hap_id", "ind_id", "deme", F.posexplode("embedding").alias("_k", "_e")).select("hap_id", "ind_id", "deme", (F.col("_k") + 1).alias("slot"), (F.col("_e") > 0).cast("int").alias("allele"))


def dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ind_id, deme, slot, g: non-zero dosages of customers at parts, at most 2."""
    cells = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    counted = cells.groupBy(F.col("o_custkey").alias("ind_id"), (F.col("l_partkey") + 1).alias("slot")).agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("g"))
    return counted.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ind_id"), F.col("c_nationkey").alias("deme")), "ind_id")


def part_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, chr, bp, alpha, is_qtl: one row for each part."""
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("slot"))
    return parts.crossJoin(F.broadcast(parts.agg(F.max("slot").alias("loci")))).select("slot", *_site(F.col("slot"), F.col("loci")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gen, chr, parent, child, left, right: line items as genealogical edges, from order (parent) to part (child)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("gen"), (1 + F.col("l_suppkey") % CHROMOSOMES).cast("int").alias("chr"), F.col("l_orderkey").alias("parent"),
        F.col("l_partkey").alias("child"), F.col("l_partkey").alias("left"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("right"),
    )


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gen, value: events in order of time as a series of statistics."""
    from pyspark.sql import Window

    return table(spark, sf_dir, "events").select("ts", "event_id", "value", F.col("user_id").alias("run")).withColumn("gen", F.row_number().over(Window.partitionBy("run").orderBy("ts", "event_id"))).select("run", "gen", "value")


# The same relations in DuckDB SQL, to begin a WITH list.
SQL = """
vec AS (SELECT vec_id AS hap_id, vec_id // 2 AS ind_id, label, embedding FROM embeddings),
sites AS (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS slot, (SELECT max(len(embedding)) FROM embeddings) AS loci),
variants AS (SELECT slot, (1 + floor((slot - 1) / ceil(loci / 4.0)))::INTEGER AS chr, (1 + (slot * 7919) % 100000)::INTEGER AS bp,
  CASE WHEN (slot * 104729) % 2001 = 1000 THEN 0.0001 ELSE ((slot * 104729) % 2001 - 1000) / 10000.0::DOUBLE END::DOUBLE AS alpha, slot % 8 <> 0 AS is_qtl FROM sites),
hap AS (SELECT hap_id, ind_id, deme, slot, (e > 0)::INTEGER AS allele FROM (
  SELECT hap_id, ind_id, d.deme, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS slot
  FROM vec JOIN (SELECT ind_id, label AS deme FROM vec WHERE hap_id % 2 = 0) d USING (ind_id))),
geno AS (SELECT ind_id, deme, slot, sum(allele)::INTEGER AS g FROM hap GROUP BY ALL),
freq AS (SELECT slot, sum(allele)::DOUBLE / count(*) AS p FROM hap GROUP BY slot),
bv AS (SELECT ind_id, deme, sum(CASE WHEN is_qtl THEN alpha * g ELSE 0 END) AS a FROM geno JOIN variants USING (slot) GROUP BY ALL),
qtl AS (SELECT slot, chr, bp, alpha, p FROM variants JOIN freq USING (slot) WHERE is_qtl AND alpha <> 0 AND least(p, 1 - p) >= 0.01)"""
