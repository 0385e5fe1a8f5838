"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm._tables import BROADCAST_BYTES, Scratch, salted_left_join

#: Code points of a text that the second refinement hashes.
PREFIX = 64


def _keep_shared(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The key values that more than one row has, and how many such values there are."""
    shared = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return shared, shared.count()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """Groups documents whose texts are identical, and says which row of each group stays.

    Three refinements, each on what the last one left: byte length, a hash of the first 64 code points, and
    SHA-256 of the whole text. Only the last reads full content, and only of rows whose length and prefix are
    shared. Hashes travel, texts never do. Of equal texts the row with the largest id stays.

    Returns one row per input row: the id, keep_id, group_size, kept, text_sha256. text_sha256 is null for rows
    that an earlier refinement proved unique, unless `digest_all`.

    Null texts count as empty texts. Ids may be null: a null id is smaller than any other. Rows that repeat id
    and text count each in group_size, and exactly one of them is kept. An empty table gives an empty result.
    Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.octet_length(text).alias("_len"), text.alias("_text"))
    prefixed = rows.withColumn("_pre", F.xxhash64(F.substring("_text", 1, PREFIX)))

    lengths, n_lengths = _keep_shared(rows.select("_len"), ["_len"])
    by_length = prefixed.select("_len", "_pre").join(F.broadcast(lengths) if n_lengths * 4 <= BROADCAST_BYTES else lengths, "_len", "left_semi")
    scratch = Scratch(spark)
    shared = scratch.write("shared", _keep_shared(by_length, ["_len", "_pre"])[0].withColumn("_shared", F.lit(True)))
    n_shared = shared.count()

    digest = F.sha2("_text", 256)
    if n_shared * 16 <= BROADCAST_BYTES:
        marked = prefixed.join(F.broadcast(shared), ["_len", "_pre"], "left")
        hashed = marked.select("_id", F.when(F.col("_shared") | F.lit(digest_all), digest).alias("_sha"), "_shared")
    else:
        # the survivors are too many to broadcast: hash in the scan, so that no text is shuffled
        keyed = prefixed.select("_id", "_len", "_pre", digest.alias("_sha"))
        marked = salted_left_join(keyed, shared, ["_len", "_pre"], F.xxhash64("_sha", "_id"))
        hashed = marked.select("_id", F.when(F.col("_shared") | F.lit(digest_all), F.col("_sha")).alias("_sha"), "_shared")
    hashed = scratch.write("hashed", hashed)

    alone = hashed.where("_shared is null").select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), "_sha")
    rest = hashed.where("_shared").select("_id", "_sha")
    groups = rest.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    joined = salted_left_join(rest, groups, ["_sha"], F.xxhash64("_id")).select("_id", "_keep", "_size", "_sha")
    lost = joined.where(~F.col("_id").eqNullSafe(F.col("_keep"))).withColumn("_kept", F.lit(False))
    # the row that stays may be there more than once: one of its copies stays
    stays = (
        joined.where(F.col("_id").eqNullSafe(F.col("_keep")))
        .groupBy("_id", "_keep", "_size", "_sha")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .select("_id", "_keep", "_size", "_sha", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
        .select("_id", "_keep", "_size", "_sha", (F.col("_copy") == 1).alias("_kept"))
    )
    return (
        lost.unionByName(stays)
        .unionByName(alone.withColumn("_kept", F.lit(True)))
        .select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without those that `exact_duplicates` drops.

    Rows that repeat id and text are equal rows here: one stays. Rows with one id and different texts are told
    apart by their texts' hashes.
    """
    lost = exact_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("_lost_id"), F.col("text_sha256").alias("_lost_sha"))
    twice = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count() > 0
    if not twice:
        return docs.join(lost.select("_lost_id").distinct(), docs[id_col].eqNullSafe(F.col("_lost_id")), "left_anti")
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    found = exact_duplicates(docs, id_col, text_col, digest_all=True).where("kept").select(F.col(id_col).alias("_keep_id"), F.col("text_sha256").alias("_keep_sha")).distinct()
    keyed = docs.join(found, docs[id_col].eqNullSafe(F.col("_keep_id")) & (sha == F.col("_keep_sha")), "left_semi")
    return keyed.dropDuplicates([id_col, text_col])


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
