"""Repeated runs of lines: a suffix array over line-ID sequences by prefix doubling; later copies are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm._tables import BROADCAST_BYTES, Scratch, salted_left_join

#: A run has two lines or more, or is one line of more words than this, or a document's only line.
LONG_WORDS = 50
_BLANK = r"^[\x20\x09-\x0D]*$"


def _sequence(text: Column) -> Column:
    """A text's lines with a word, in order: two independent hashes that stand for the line, and whether it is long."""
    # so many words need more characters than twice as many
    long = lambda x: (F.length(x) > 2 * LONG_WORDS) & (F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")) > LONG_WORDS)
    return F.transform(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(_BLANK)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"), long(x).alias("long")))


def _intervals(suffixes: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The intervals of the suffix array with several suffixes: keys, interval (where it begins) and first suffix.

    Equal keys are counted before they travel. Distinct ones are sorted by ranges; where a range begins is a sum over
    the ranges before it, one number for each.
    """
    order = F.struct("id", "h", "pos")
    groups = suffixes.groupBy(*keys).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("size"))
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.write(name, groups.repartitionByRange(parts, *keys).withColumn("_p", F.spark_partition_id()))
    # a row for each range
    sums = ranged.groupBy("_p").agg(F.sum("size").alias("_n"))
    bases = sums.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))
    before = F.sum("size").over(Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("_before", F.coalesce(before, F.lit(0))).join(F.broadcast(bases), "_p")
    return placed.where(F.col("first") < F.col("last")).select(*keys, (F.col("_base") + F.col("_before")).alias("interval"), "first")


def repeated_runs(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Suffixes that begin with a run found earlier: id, h, pos, length, source_id, source_pos.

    Prefix doubling: suffixes that share their first lines form an interval of the suffix array, and a suffix's rank
    is where its interval begins. A round pairs a suffix's rank with that of the suffix 2 ** k lines on, so intervals
    are those of twice as many common lines. Suffixes alone in their interval, or compared to their document's end,
    leave. The order of documents is that of (id, hash of the text): a run's source is the first suffix of the longest
    interval of 2 ** k lines in which it is not the first.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("h"), _sequence(text).alias("s"))
    seeds = rows.select("id", "h", F.size("s").alias("n"), F.posexplode("s").alias("pos", "line"))
    seeds = scratch.write("seeds", seeds.select("id", "h", "n", "pos", F.col("line.a").alias("a"), F.col("line.b").alias("b"), (F.col("line.long") | (F.col("n") == 1)).alias("whole")))
    shared = scratch.write("level0", _intervals(seeds, ["a", "b"], scratch, "ranged0"))
    level = _members(seeds, shared, ["a", "b"], scratch, "ranks0")
    scratch.drop("seeds", "ranged0", "level0")
    copies, k = None, 0
    while True:
        later = level.where((F.col("first") < F.struct("id", "h", "pos")) & (F.lit(k > 0) | F.col("whole"))).select("id", "h", "pos", F.lit(1 << k).alias("length"), F.col("first.id").alias("source_id"), F.col("first.pos").alias("source_pos"))
        copies = later if copies is None else copies.unionByName(later)
        # suffixes with fewer lines left than the next level compares are compared in full by now
        far = level.select(F.col("id").alias("id2"), F.col("h").alias("h2"), (F.col("pos") - (1 << k)).alias("pos2"), F.col("rank").alias("rank2")).distinct()
        same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")) & (F.col("pos") == F.col("pos2"))
        near = level.where(F.col("pos") + (2 << k) <= F.col("n")).drop("first")
        pairs = scratch.write(f"pairs{k + 1}", near.join(far, same).select("id", "h", "n", "pos", "whole", "rank", "rank2"))
        if not pairs.limit(1).count():
            return copies
        k += 1
        groups = scratch.write(f"level{k}", _intervals(pairs, ["rank", "rank2"], scratch, f"ranged{k}"))
        level = _members(pairs, groups, ["rank", "rank2"], scratch, f"ranks{k}")
        scratch.drop(f"pairs{k}", f"ranged{k}", f"level{k}")


def _members(suffixes: DataFrame, intervals: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Suffixes with their interval as rank, without those that are alone in theirs."""
    found = salted_left_join(suffixes, intervals, keys, F.xxhash64("id", "h", "pos")).where("first is not null")
    return scratch.write(name, found.select("id", "h", "n", "pos", "whole", F.col("interval").alias("rank"), "first"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deletes lines of later copies of repeated runs: adds n_lines, removed_lines, longest_run and clean_text.

    A run is two or more neighbouring lines, those without a word left out, or one line of over LONG_WORDS words, or a
    document's only line, that is also found earlier: in a document of smaller id, or further up in the same one,
    overlaps included. Every line of such a later copy goes, and
    lines without a word stay. longest_run is the length of the longest stretch of neighbouring lines that go.

    Null and empty texts have no lines and clean_text ''. A null id is smaller than any other. Of documents with one id
    the one with the smaller hash of its text is earlier; rows that repeat id and text are one document and get the
    same result. An empty table stays empty. Input columns named like an output are replaced.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "removed_lines", "longest_run", "clean_text")]
    copies = repeated_runs(docs, scratch, id_col, text_col)
    places = F.flatten(F.collect_list(F.sequence("pos", F.col("pos") + F.col("length") - 1)))
    gone = scratch.write("gone", copies.groupBy("id", "h").agg(F.sort_array(F.array_distinct(places)).alias("gone")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*others, F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"))
    size = gone.agg(F.sum(4 * F.size("gone") + 40)).first()[0] or 0
    marked = rows.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h")), "left")
    # ordinals of lines with a word, by place: a line goes if its ordinal is in `gone`
    each = F.split(text, "\n")
    full_at = F.filter(F.transform(each, lambda x, i: F.when(~x.rlike(_BLANK), i)), lambda i: i.isNotNull())
    lost = F.transform("gone", lambda k: F.get(full_at, k))
    kept = F.array_except(F.transform(each, lambda x, i: i), lost)
    clean = F.array_join(F.transform(kept, lambda i: F.get(each, i)), "\n")
    stretches = F.aggregate(
        F.col("gone"),
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda a, p: F.struct(p.alias("last"), F.when(p == a["last"] + 1, a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["best"], F.when(p == a["last"] + 1, a["run"] + 1).otherwise(1)).alias("best")),
        lambda a: a["best"],
    )
    full = F.size(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(_BLANK)))
    return marked.select(
        *others,
        full.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("removed_lines"),
        F.coalesce(stretches, F.lit(0)).cast("long").alias("longest_run"),
        F.when(F.col("gone").isNull(), text).otherwise(clean).alias("clean_text"),
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
full_lines AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n
  FROM lines WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*')),
pairs AS (
  SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM full_lines),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) AS nth FROM pairs WHERE next IS NOT NULL) WHERE nth > 1),
alone AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, line, n, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM full_lines)
  WHERE nth > 1 AND (n = 1 OR len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50)),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos FROM later UNION ALL SELECT doc_id, pos + 1 FROM later UNION ALL SELECT doc_id, pos FROM alone)),
runs AS (
  SELECT doc_id, max(n) AS longest FROM (
    SELECT doc_id, count(*) AS n FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g)
  GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS clean, count(f.pos) AS n
  FROM lines l LEFT JOIN full_lines f ON f.doc_id = l.doc_id AND f.i = l.i LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.pos = f.pos
  WHERE g.pos IS NULL GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM full_lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(c.n, 0) - coalesce(k.n, 0) AS removed_lines, coalesce(r.longest, 0) AS longest_run, sha256(coalesce(k.clean, '')) AS clean_sha256
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN runs r ON r.doc_id = d.doc_id
"""
