"""Genealogies as edge tables: simplification, overlay of neutral mutations, placement of sites on branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covering_edges(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """Sites (site, chr, bp) with the edges that cover them: an interval join by classes of length.

    An edge's class is the power of two that its length does not exceed, so it touches two buckets of that width at most;
    a site is looked up in one bucket of each class there is (64 at most). Empty edges cover nothing.
    """
    width = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    size = F.col("right") - F.col("left")
    classed = edges.where("left < right").withColumn("_k", F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0).cast("int"))
    classes = [r["_k"] for r in classed.select("_k").distinct().collect()]  # at most 64 numbers
    a = sites.withColumn("_k", F.explode(F.array(*map(F.lit, classes)).cast("array<int>"))).withColumn("_b", F.floor(F.col("bp") / width(F.col("_k"))))
    b = classed.withColumn("_b", F.explode(F.sequence(F.floor(F.col("left") / width(F.col("_k"))), F.floor((F.col("right") - 1) / width(F.col("_k"))))))
    return a.join(b, ["chr", "_k", "_b"]).where("bp >= left and bp < right").drop("_k", "_b")


def simplify(edges: DataFrame, samples: DataFrame, generations: list[int], write) -> DataFrame:
    """Edges above the samples: from the newest generation back, an edge stays if its child is alive; then its parent is.

    `generations` is the distinct generations, newest first. `write(df, name)` cuts lineage: state is one set of nodes.
    """
    alive, kept = samples.select("chr", "node").distinct(), None
    for g in generations:
        here = edges.where(F.col("gen") == g)
        stays = here.join(alive.withColumnRenamed("node", "child"), ["chr", "child"], "left_semi")
        kept = stays if kept is None else kept.unionByName(stays)
        alive = write(alive.union(stays.select("chr", F.col("parent").alias("node"))).distinct(), f"alive{g}")
    return kept


def branch_choice(covering: DataFrame, u: Column, length: Column) -> DataFrame:
    """One covering edge for each site, with chance in proportion to `length`; ties of running sums go to the first."""
    w = Window.partitionBy("site").orderBy("gen", "parent", "child").rowsBetween(Window.unboundedPreceding, 0)
    run = covering.withColumn("_cum", F.sum(length).over(w)).withColumn("_u", u * F.sum(length).over(Window.partitionBy("site")))
    reached = run.where(F.col("_cum") >= F.col("_u")).withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy("_cum", "gen", "parent", "child")))
    return reached.where("_k = 1").drop("_cum", "_u", "_k")


def overlay_mutations(edges: DataFrame, count: Column, position: Column) -> DataFrame:
    """chr, gen, parent, child, i, bp of neutral mutations: `count` of them on an edge, `position` from the edge and the number i."""
    drawn = edges.withColumn("_n", count).where("_n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return drawn.select("chr", "gen", "parent", "child", "i", position.alias("bp"))


def descend(mutations: DataFrame, edges: DataFrame) -> DataFrame:
    """One step towards the samples: mutations (chr, node, bp) pass to children over edges of their node that cover them."""
    down = edges.select("chr", F.col("parent").alias("node"), "child", "left", "right")
    return mutations.join(down, ["chr", "node"]).where("bp >= left and bp < right").select("chr", F.col("child").alias("node"), "bp")


def carry_down(begun: DataFrame, edges: DataFrame, keys: list[str], generations: list[int], write, samples: DataFrame | None = None) -> DataFrame:
    """chr, node and `keys` (bp among them), each once: what begins at nodes, and all that covering edges pass on to children.

    `begun` has gen as well: the generation in which a row is there first. In a generation's turn, oldest first, children
    get what their parents had before it, where the edge covers bp. `write(df, name)` cuts lineage after each one. With a
    number of the mutation among `keys`, repeated hits of one position stay apart.

    With `samples` (node) only their rows come out, and a node's rows are dropped after the last generation in which it is
    a parent: what is held is what later generations can still inherit. Edges stored by generation are read once.
    """
    last = None if samples is None else write(edges.groupBy("chr", F.col("parent").alias("node")).agg(F.max("gen").alias("_last")), "last")
    held, out, rows = None, [], [*keys, "chr", "node"]
    for g in generations:
        here = begun.where(F.col("gen") == g).select(*rows)
        if held is not None:
            down = edges.where(F.col("gen") == g).select("chr", F.col("parent").alias("node"), "child", "left", "right")
            passed = held.join(down, ["chr", "node"]).where("bp >= left and bp < right").select(*keys, "chr", F.col("child").alias("node"))
            here = held.unionByName(here).unionByName(passed)
        here = here.distinct()
        if last is not None:
            here = here.join(last, ["chr", "node"], "left").withColumn("_live", F.coalesce(F.col("_last") > g, F.lit(False))).drop("_last")
        held = write(here, f"held{g}")
        if last is not None:
            out.append(held.where("not _live").select(*rows).join(samples.select("node").distinct(), "node", "left_semi"))
            held = held.where("_live").select(*rows)
    if held is None:
        none = begun.select(*rows).distinct()
        return none if samples is None else none.join(samples.select("node").distinct(), "node", "left_semi")
    if last is None:
        return held
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.select(*rows).distinct()


def merged_sites(trait: DataFrame, neutral: DataFrame) -> DataFrame:
    """chr, bp, snp_id, alpha of both panels in one: distinct neutral positions, trait sites with their effects."""
    name = lambda tag: F.concat_ws("_", F.concat(F.lit("chr"), F.col("chr")), F.col("bp"), F.lit(tag))
    a = trait.select("chr", "bp", name("q").alias("snp_id"), "alpha")
    b = neutral.select("chr", "bp").distinct().select("chr", "bp", name("n").alias("snp_id"), F.lit(0.0).alias("alpha"))
    return a.unionByName(b)


def renumber(nodes: DataFrame, leaves: int) -> DataFrame:
    """Node ids over chromosomes: leaves are shared, inner nodes follow those of the chromosomes before."""
    inner = nodes.groupBy("chr").agg(F.count_if(F.col("node") > leaves).alias("_n"))
    base = inner.select("chr", (F.sum("_n").over(Window.orderBy("chr")) - F.col("_n")).alias("_base"))  # a row a chromosome
    return nodes.join(F.broadcast(base), "chr").select("chr", "node", F.when(F.col("node") <= leaves, F.col("node")).otherwise(F.col("node") + F.col("_base")).alias("new_node"))


def branch_length_per_bp(edges: DataFrame, span: int) -> DataFrame:
    """chr, tbl: branch length times span, summed over edges and divided by the chromosome's length."""
    return edges.groupBy("chr").agg((F.sum(F.col("length") * (F.col("right") - F.col("left"))) / span).alias("tbl"))
