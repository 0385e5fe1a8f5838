"""Products of sites by tiles: a task holds a block of individuals of one tile of sites, or one tile of pairs of sites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.ranges import in_order

#: Sites in a tile and individuals in a block: a block of a tile has 2 MB, a tile of pairs half of one.
TILE, BLOCK = 256, 1024


def within_demes(geno: DataFrame, sites: DataFrame, correlation: bool = False) -> DataFrame:
    """ind_id, slot, x: dosages less their deme's mean, scaled so that products over all individuals are covariances within
    demes, averaged over demes of three or more by their sizes; or correlations, 0 where a site does not vary in a deme."""
    cells = geno.join(sites.select("slot"), "slot", "left_semi")
    means = cells.groupBy("deme", "slot").agg(F.avg("g").alias("_m"), F.count(F.lit(1)).alias("_n"), F.var_samp("g").alias("_v")).where("_n >= 3")
    total = means.groupBy("deme").agg(F.max("_n").alias("_w")).agg(F.sum("_w").alias("_all"))
    weight = F.sqrt(F.col("_n") / ((F.col("_n") - 1) * F.col("_all")))
    if correlation:
        weight = F.when(F.col("_v") > 1e-30, weight / F.sqrt("_v")).otherwise(0.0)
    return cells.join(means, ["deme", "slot"]).crossJoin(F.broadcast(total)).select("ind_id", "slot", ((F.col("g") - F.col("_m")) * weight).alias("x"))  # one row


def standardized(geno: DataFrame) -> DataFrame:
    """ind_id, slot, x: dosages scaled so that products over all individuals are correlations; sites that do not vary are left out."""
    moments = geno.groupBy("slot").agg(F.avg("g").alias("_m"), F.stddev_samp("g").alias("_s"), F.count(F.lit(1)).alias("_n")).where("_s > 0")
    return geno.join(moments, "slot").select("ind_id", "slot", ((F.col("g") - F.col("_m")) / (F.col("_s") * F.sqrt(F.col("_n") - 1))).alias("x"))


def numbered(sites: DataFrame) -> DataFrame:
    """The sites with `tile` and `at`, their place in it, in order of (chr, bp, slot)."""
    return in_order(sites, ["chr", "bp", "slot"], "_r").withColumn("tile", F.floor(F.col("_r") / TILE).cast("int")).withColumn("at", F.pmod("_r", F.lit(TILE)).cast("int")).drop("_r")


def _bands(places: DataFrame, near: float) -> DataFrame:
    """a, b: the pairs of tiles a <= b that can hold two sites of one chromosome at most `near` apart.

    Tiles follow the order of (chr, bp), so a later tile is in reach if it begins on the chromosome where this one ends, and
    near that end.
    """
    ends = places.groupBy("tile").agg(F.min(F.struct("chr", "bp")).alias("first"), F.max(F.struct("chr", "bp")).alias("last"))
    a = ends.select(F.col("tile").alias("a"), F.col("last.chr").alias("chr"), F.col("last.bp").alias("_to"))
    b = ends.select(F.col("tile").alias("b"), F.col("first.chr").alias("chr"), F.col("first.bp").alias("_from"))
    return a.join(b, "chr").where((F.col("a") < F.col("b")) & (F.col("_from") <= F.col("_to") + near)).select("a", "b").unionByName(ends.select(F.col("tile").alias("a"), F.col("tile").alias("b")))


def products(cells: DataFrame, places: DataFrame, write, by: str | None = None, near: float | None = None) -> DataFrame:
    """a, b, content: for tiles a <= b of `places` (slot, tile, at) the sums over individuals of products of x, as doubles.

    Individuals are numbered by ranges, so a block has the same rows in every tile. Tiles of a block meet in pairs, and a
    pair's blocks are added up one after another: a task holds two blocks and one sum, whatever there are of either. With
    `by`, a column of cells, sums are for each of its values (which come out under that name); with `near` only tiles that
    hold sites so near on a chromosome meet.
    """
    key = by or "_by"
    cells = cells if by else cells.withColumn(key, F.lit(0))
    placed_people = write(in_order(cells.select(key, "ind_id").distinct(), [key, "ind_id"], "_i"), "people")
    firsts = placed_people.groupBy(key).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    at = F.col("_i") - F.col("_first")
    people = placed_people.join(firsts, key).select(key, "ind_id", F.floor(at / BLOCK).cast("int").alias("block"), F.pmod(at, F.lit(BLOCK)).cast("int").alias("row"), F.least(F.lit(BLOCK), F.col("_n") - F.floor(at / BLOCK) * BLOCK).cast("int").alias("rows"))
    placed = cells.join(places.select("slot", "tile", "at"), "slot").join(people, [key, "ind_id"])

    def dense(group: pa.Table) -> pa.Table:
        x = np.zeros((group.column("rows")[0].as_py(), TILE))
        x[group.column("row").to_numpy(), group.column("at").to_numpy()] = group.column("x").to_numpy()
        return pa.table({key: group.column(key)[:1], "block": group.column("block")[:1], "tile": group.column("tile")[:1], "content": pa.array([x.tobytes()], pa.binary())})

    # numbers of partitions are given, since a few small rows are much work here
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = placed.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, block int, tile int, content binary"
    tiles = write(placed.select(key, "block", "tile", "row", "rows", "at", "x").repartition(parts, key, "block", "tile").groupBy(key, "block", "tile").applyInArrow(dense, shape), "tiles")
    other = tiles.select(key, "block", F.col("tile").alias("b"), F.col("content").alias("right"))
    mine = tiles.select(key, "block", F.col("tile").alias("a"), F.col("content").alias("left"))
    if near is None:
        both = mine.join(other, [key, "block"]).where("a <= b")
    else:
        both = mine.join(_bands(places, near), "a").join(other, [key, "block", "b"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, total.tobytes()), (key_type, pa.int32(), pa.int32(), pa.binary()), strict=True)], names=[key, "a", "b", "content"])

        for batch in batches:
            key_type = batch.schema.field(key).type
            for k in range(batch.num_rows):
                one = tuple(batch.column(c)[k].as_py() for c in (key, "a", "b"))
                if one != now:
                    if now is not None:
                        yield told()
                    now, total = one, np.zeros((TILE, TILE))
                left, right = (np.frombuffer(batch.column(c)[k].as_buffer(), "f8").reshape(-1, TILE) for c in ("left", "right"))
                total += left.T @ right
        if now is not None:
            yield told()

    summed = both.select(key, "a", "b", "left", "right").repartition(parts, key, "a", "b").sortWithinPartitions(key, "a", "b").mapInArrow(add, f"{key} {kind}, a int, b int, content binary")
    return summed if by else summed.drop(key)


def pairs(made: DataFrame, places: DataFrame, by: str | None = None, near: float | None = None) -> DataFrame:
    """j, k, r of the pairs of different sites, j before k in the order of `places`: a row each, as the result has them.

    With `by` they are for each of its values; with `near` only pairs of one chromosome so near each other come out.
    """
    extra = [by] if by else []
    kind = f"{by} {made.schema[by].dataType.simpleString()}, " if by else ""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                r = np.frombuffer(batch.column("content")[n].as_buffer(), "f8").reshape(TILE, TILE)
                x, y = np.triu_indices(TILE, 1) if a == b else np.indices((TILE, TILE)).reshape(2, -1)
                same = [pa.array([batch.column(c)[n].as_py()] * len(x), batch.schema.field(c).type) for c in extra]
                whole = lambda v, like: pa.array(np.full(len(like), v, "i4"))
                yield pa.RecordBatch.from_arrays([*same, whole(a, x), pa.array(x.astype("i4")), whole(b, y), pa.array(y.astype("i4")), pa.array(r[x, y])], names=[*extra, "a", "x", "b", "y", "r"])

    cells = made.select(*extra, "a", "b", "content").mapInArrow(unpack, f"{kind}a int, x int, b int, y int, r double")
    side = lambda slot, tile, at, m: places.select(F.col("slot").alias(slot), F.col("tile").alias(tile), F.col("at").alias(at), F.col("chr").alias(f"_chr{m}"), F.col("bp").alias(f"_bp{m}"))
    found = cells.join(side("j", "a", "x", 1), ["a", "x"]).join(side("k", "b", "y", 2), ["b", "y"])
    if near is not None:
        found = found.where((F.col("_chr1") == F.col("_chr2")) & (F.abs(F.col("_bp1") - F.col("_bp2")) <= near))
    return found.select(*extra, "j", "k", "r")
