"""Mixing sources to target weights: thresholds on a hash, found in histograms that refine only the bucket at the budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm._tables import BROADCAST_BYTES, Scratch, salted_left_join
from driftline.operators import ranges

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the input, and how often a source may repeat.
SHARE, MOST = 1.5, 2
#: Bits of the hash that one histogram resolves, bits of a document's hash, and bits of the number that tells equal rows apart.
STEP_BITS, HASH_BITS, ROW_BITS = 12, 60, 72
#: Bytes of a row of one source's figures, for the measure of what may be broadcast.
SOURCE_ROW = 256


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of id and whole text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _bucket(level: int) -> Column:
    """The bits of a row's place in the order (hash, row number) that the histogram of this level resolves."""
    at, bits, name = (level * STEP_BITS, HASH_BITS, "_h") if level * STEP_BITS < HASH_BITS else (level * STEP_BITS - HASH_BITS, ROW_BITS, "_u")
    return F.shiftright(name, bits - STEP_BITS - at).bitwiseAND(F.lit(2**STEP_BITS - 1)).cast("int")


def _fits(rows: DataFrame) -> bool:
    return rows.count() * SOURCE_ROW <= BROADCAST_BYTES


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds `weight` and `target` to one row a source (`source`, `source_size`).

    Sources take the weights in turn in code-point order, null last. They share `share` times all sizes by weight; a
    target stops at `most` times the source's size, and what is over is shared again by weight among the others until
    none is above. Each round is one aggregate over the sources; the level of the shares only rises, so rounds end.
    """
    numbered = ranges.running_sum(sources.withColumn("_none", F.col("source").isNull()).withColumn("_one", F.lit(1)), [], ["_none", "source"], "_one", "_rank")
    place = F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int")
    weighed = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1)).drop("_none", "_one", "_rank")
    cap = F.col("source_size") * most
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    goal, full, free, capped = share * total["s"], 0, total["w"], -1
    while free:
        over = F.when(cap < F.col("weight") * F.lit(goal - full) / F.lit(free), 1)
        now = weighed.agg(F.count(over).alias("n"), F.coalesce(F.sum(cap * over), F.lit(0)).alias("full"), F.coalesce(F.sum(F.col("weight") * over), F.lit(0)).alias("taken")).first()
        if now["n"] == capped or now["taken"] == total["w"]:
            break
        full, free, capped = now["full"], total["w"] - now["taken"], now["n"]
    shared = F.col("weight") * F.lit(goal - full) / F.lit(free or 1)
    return weighed.withColumn("target", F.least(cap.cast("double"), shared.cast("double")))


def _thresholds(rows: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """`_key`, `_th`, `_tu`, `_last`: a source takes once more the rows below (_th, _tu), and that row itself if `_last`.

    Every level sums sizes by source and bucket and goes on in the one bucket that crosses the budget, until one row is
    left in it: a row in a few thousand goes on from level to level.
    """
    open_rows = rows.where("_size > 0")
    bound = scratch.write("budgets", sources.where("_rest > 0").select("_key", "_rest", F.lit(0).cast("long").alias("_base")))
    found, level = [], 0
    while True:
        above = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = open_rows.withColumn("_b", _bucket(level)).groupBy("_key", "_b").agg(F.sum("_size").alias("_s"), F.count("*").alias("_n"), F.min("_h").alias("_th"), F.min("_u").alias("_tu"))
        crossing = sums.join(bound, "_key").withColumn("_before", F.coalesce(F.sum("_s").over(above), F.lit(0)) + F.col("_base")).where("_before + _s > _rest and _before <= _rest")
        at = scratch.write(f"crossing{level}", crossing.select("_key", "_b", "_rest", F.col("_before").alias("_base"), "_s", "_n", "_th", "_tu"))
        found.append(at.where("_n = 1").select("_key", "_th", "_tu", (2 * F.col("_base") + F.col("_s") <= 2 * F.col("_rest")).alias("_last")))
        bound = at.where("_n > 1")
        level += 1
        if bound.isEmpty():
            break
        inner = bound.select("_key", "_b")
        inner = F.broadcast(inner) if _fits(inner) else inner
        open_rows = scratch.write(f"rows{level}", open_rows.withColumn("_b", _bucket(level - 1)).join(inner, ["_key", "_b"]).drop("_b"))
        bound = bound.select("_key", "_rest", "_base")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return scratch.write("thresholds", every)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = False) -> DataFrame:
    """One row per document: its columns (the text only if `keep_text`), size, source_size, target, copies and taken.

    A source takes all its documents target / size times, rounded down, and once more those whose hash lies below a
    threshold: of documents in order of their hash those that bring it nearest to its target. Only whole documents are
    taken, so a source misses its target by at most half of one document; a larger share keeps what a smaller one takes.
    Hashes are of id and text, so results do not depend on partitions.

    A null text has size 0. Documents without a source are a source of their own. Rows that are equal in id and text
    are told apart by their row number, and as many are taken as the budget asks for. An empty table gives none. Input
    columns named like an output are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    outputs = ("size", "source_size", "target", "copies", "taken")
    others = [c for c in docs.columns if c.lower() not in outputs and not c.startswith("_") and (keep_text or c != text_col)]
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = scratch.write("rows", docs.select(*others, key.alias("_key"), words(F.col(text_col)).alias("_size"), _hash(F.col(id_col), F.col(text_col)).alias("_h"), F.monotonically_increasing_id().alias("_u")))
    sizes = rows.groupBy("_key").agg(F.sum("_size").alias("source_size")).withColumn("source", F.when(F.col("_key") != "n", F.expr("substring(_key, 2)")))
    whole = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("int")
    shares = targets(sizes, weights, share, most).withColumn("_copies", whole).withColumn("_rest", F.col("target") - F.col("_copies") * F.col("source_size"))
    sources = scratch.write("sources", shares.select("_key", "source_size", "target", "_copies", "_rest"))
    limits = sources.join(_thresholds(rows.select("_key", "_size", "_h", "_u"), sources, scratch), "_key", "left").drop("_rest")
    joined = rows.join(F.broadcast(limits), "_key", "left") if _fits(sources) else salted_left_join(rows, limits, ["_key"], F.col("_h"))
    below = (F.col("_h") < F.col("_th")) | ((F.col("_h") == F.col("_th")) & ((F.col("_u") < F.col("_tu")) | ((F.col("_u") == F.col("_tu")) & F.col("_last"))))
    copies = F.col("_copies") + F.when(F.coalesce(below, F.lit(False)), 1).otherwise(0)
    return joined.select(*others, F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("_size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of `docs`."""
    mixed = mix(docs, keep_text=True, **how).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[c for c in docs.columns if c in mixed.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS goal FROM s),
c AS (
  SELECT *, row_number() OVER ranked AS place, coalesce(sum(cap) OVER before, 0)::BIGINT AS capped, (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS free FROM w
  WINDOW ranked AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST), before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT capped, free FROM c WHERE cap >= weight * (goal - capped) / free ORDER BY place LIMIT 1),
t AS (SELECT c.source, source_size, least(cap::DOUBLE, weight * (goal - l.capped) / l.free) AS target FROM c, l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
r AS (SELECT d.*, source_size, target, copies, target - copies * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (copies + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
