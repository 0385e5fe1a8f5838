"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from driftline.llm import bpe, chat_format, exact_dedup, jaccard_join, line_dedup, mixing, packing, prefix_trie, quality_rules, repair, toxicity, turn_repair, wrappers
from driftline.llm._tables import Scratch, ship, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    spec = bpe.from_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), spec), spec)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "removed_lines", "longest_run", F.sha2("clean_text", 256).alias("clean_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scored = toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score", "predicted", "evidence")


def op4_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return wrappers.extract_main_text(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)


def op7_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = f"{Scratch(spark).root}/ids"
    repair.write_ids(table(spark, sf_dir, "documents"), path, bpe.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return repair.read_ids(spark, path, digest=True)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    records = chat_format.records_of_turns(table(spark, sf_dir, "conversations"))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(odd).alias("prompt"), F.lit(odd).alias("response"))).alias("payload"))
    done = chat_format.format_chats(records.unionByName(extra))
    read = done.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), chat_format.read_formatted(F.col("formatted")).alias("turns"), chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), bpe.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = table(spark, sf_dir, "conversations")
    return turn_repair.repair_report(turn_repair.damaged(rows), rows)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_html_wrappers": op4_html_wrappers,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_repair_files": op7_repair_files,
    "op8_chat_format": op8_chat_format,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_turn_repair": op11_turn_repair,
    "op12_source_mix": op12_source_mix,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_chat_format": chat_format.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_turn_repair": turn_repair.SQL,
    "op12_source_mix": mixing.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
