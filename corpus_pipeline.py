"""The corpus pipeline: toxicity, quality rules, exact dedup, near dedup and packing over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and all but the last return the
columns of documents. A stage's result is written as Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftline.llm import bpe, exact_dedup, jaccard_join, packing, quality_rules, toxicity
from driftline.llm._tables import Scratch, ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is predicted go; the model is fitted on the labels of what is left of `docs`."""
    ship(spark)
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or lose too much text to line rules, go; the others keep their text whole."""
    return quality_rules.drop_bad(docs).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the row with the least id stays; rows go, not ids."""
    ship(spark)
    return jaccard_join.drop_near_duplicates(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences."""
    ship(spark)
    return packing.pack_documents(docs, bpe.from_file(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_quality), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("best_fit_packing", pack)]

#: The toxicity stage's model is none that SQL expresses; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(name, docs)
    return docs
