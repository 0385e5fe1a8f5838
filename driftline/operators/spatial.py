"""Demes on a grid: neighbours, staying probabilities, clines, source demes and weighted parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators import ranges


def grid_neighbours(demes: DataFrame, g: int, migration: float) -> DataFrame:
    """deme, neighbour, prob_stay for a g x g grid without wrap-around; `demes` has a column `deme` from 1."""
    x, y = (F.col("deme") - 1) % g, F.floor((F.col("deme") - 1) / g)
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    near = demes.select("deme", x.alias("x"), y.alias("y"), F.explode(steps).alias("s")).select("deme", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    near = near.where(F.col("x").between(0, g - 1) & F.col("y").between(0, g - 1)).withColumn("neighbour", (F.col("x") + F.col("y") * g + 1).cast("long"))
    return near.withColumn("prob_stay", 1 - migration * F.count(F.lit(1)).over(Window.partitionBy("deme"))).select("deme", "neighbour", "prob_stay")


def cline_offset(deme: Column, g: int, amplitude: float, sd: float) -> Column:
    """Optimum offset along y: from -amplitude to +amplitude deviations over the grid; 0 for one deme."""
    if g == 1:
        return F.lit(0.0)
    h = (g - 1) / 2
    return amplitude * sd * (F.floor((deme - 1) / g) - h) / h


def source_deme(draws: DataFrame, neighbours: DataFrame, stay: Column, pick: Column) -> DataFrame:
    """Adds `source`: the own deme with its staying probability, else one of its neighbours, all alike."""
    lists = neighbours.groupBy("deme").agg(F.sort_array(F.collect_list("neighbour")).alias("_near"), F.first("prob_stay").alias("_stay"))  # at most four
    joined = draws.join(F.broadcast(lists), "deme", "left")
    one = F.get("_near", F.floor(pick * F.size("_near")).cast("int"))
    return joined.withColumn("source", F.when(F.col("_stay").isNull() | (stay < F.col("_stay")), F.col("deme").cast("long")).otherwise(one)).drop("_near", "_stay")


def cumulative(weights: DataFrame, by: str = "deme", order: str = "ind_id", weight: str = "w") -> DataFrame:
    """Adds `cum`, the running sum of weights within a deme, and `before`, that of the rows above."""
    return ranges.running_sum(weights, [by], [order], weight, "cum").withColumn("before", F.col("cum") - F.col(weight))


def weighted_parent(draws: DataFrame, weights: DataFrame, u: str = "u", by: str = "deme") -> DataFrame:
    """draw and parent: the first individual of the draw's deme whose running weight reaches u times the total.

    Draws and individuals of a deme are put in one order by weight, and each draw takes the next individual: one sort
    instead of a range join.
    """
    total = weights.groupBy(by).agg(F.sum("w").alias("_total"))
    points = cumulative(weights, by).select(by, F.col("cum").alias("_at"), F.lit(1).alias("_kind"), F.col("ind_id").alias("_ind"), F.lit(None).cast("long").alias("draw"))
    asked = draws.join(F.broadcast(total), by).select(by, (F.col(u) * F.col("_total")).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_ind"), F.col("draw").cast("long"))
    both = ranges.next_known(points.union(asked), [by], ["_at", "_kind", "_ind"], "_ind", "parent")
    return both.where("_kind = 0").select(by, "draw", "parent")


def layout(demography: str, n: int, grid: int, begun: bool = True) -> tuple[int, int]:
    """How many demes a population has and how many individuals each: one deme of n if all mix, grid * grid of n each on a
    grid. A grid that is recent starts, while not `begun`, as one deme of all its individuals."""
    if demography == "panmictic":
        return 1, n
    if demography == "twoD_perp" or (demography == "twoD_recent" and begun):
        return grid * grid, n
    if demography == "twoD_recent":
        return 1, n * grid * grid
    raise ValueError(f"no demography: {demography}")


def deme_of(individual: Column, per_deme: int) -> Column:
    """The deme, from 1, of an individual counted from 1: individuals of a deme follow one another."""
    return (F.floor((individual - 1) / per_deme) + 1).cast("long")
