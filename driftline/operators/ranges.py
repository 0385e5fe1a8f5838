"""Running values over rows of one order, by ranges of it: what a range needs of those before it is one row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.sources import state


def by_ranges(rows: DataFrame, order: list) -> DataFrame:
    """The rows with `_part`, the number of their range of the order, written so that all steps see the same ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return state.written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _with_carry(rows: DataFrame, by: list[str], carry: DataFrame) -> DataFrame:
    """Rows with `_carry` of their group and range; at most a row for each range and each group."""
    same = F.col("_part") == F.col("_cpart")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_c{c}"))
    keyed = carry.withColumnsRenamed({"_part": "_cpart", **{c: f"_c{c}" for c in by}})
    return rows.join(keyed, same, "left").drop("_cpart", *[f"_c{c}" for c in by])


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`name`: the sum of `value` over the rows of its group up to each row in the order."""
    ranged = by_ranges(rows, [*by, *order])
    within = ranged.withColumn("_own", F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    above = F.sum("_s").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carry = ranged.groupBy(*by, "_part").agg(F.sum(value).alias("_s")).withColumn("_carry", above).drop("_s")
    return _with_carry(within, by, carry).withColumn(name, F.col("_own") + F.coalesce("_carry", F.lit(0))).drop("_own", "_carry", "_part")


def next_known(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`name`: the value of the row itself or, where it is null, of the first one after it in the order that has one."""
    down: list[Column] = [F.desc(c) for c in order]
    ranged = by_ranges(rows, [*by, *down])
    # from the far end, so that each row adds to what is known of those before it
    last = F.last(value, ignorenulls=True)
    within = ranged.withColumn("_own", last.over(Window.partitionBy(*by, "_part").orderBy(*down).rowsBetween(Window.unboundedPreceding, 0)))
    ends = ranged.where(F.col(value).isNotNull()).groupBy(*by, "_part").agg(F.min_by(value, F.struct(*order)).alias("_v"))
    every = ranged.select(*by, "_part").distinct().join(ends, [*by, "_part"], "left")
    carry = every.withColumn("_carry", F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_v")
    return _with_carry(within, by, carry).withColumn(name, F.coalesce("_own", "_carry")).drop("_own", "_carry", "_part")


def in_order(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """`name`: places from 0 in the order of `by`, from counts of ranges, so that no task orders all rows."""
    within = by_ranges(rows, by).withColumn("_w", F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1)
    sizes = within.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    starts = sizes.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_start"))  # a row a partition
    placed = within.join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_w")).drop("_part", "_w", "_start", "_c")
