"""Coalescence times of samples in the local trees of a genealogy, within and between demes, without a row for any pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.ranges import in_order

#: Rows of a local tree, and these times demes, that one task may hold; of larger trees leaves are cut first.
TREE_ROWS, TREE_CELLS = 200_000, 4_000_000
_OUT = "chr int, stretch long, span long, within_time double, within_pairs double, all_time double, all_pairs double"


def stretches(edges: DataFrame, write) -> DataFrame:
    """The edges (chr, left, right, parent, child and more) with `stretch` and `span`, a row for each stretch they cover.

    Stretches lie between neighbouring ends of edges of a chromosome, so one has one local tree. Ends are numbered by
    ranges and edges find theirs by equality; a row of an edge grows with the ends between its own.
    """
    ends = edges.select("chr", F.col("left").alias("_at")).union(edges.select("chr", "right")).distinct()
    numbered = write(in_order(ends, ["chr", "_at"], "_n"), "ends")
    next_end = numbered.select("chr", (F.col("_n") - 1).alias("_n"), F.col("_at").alias("_next"))
    spans = write(numbered.join(next_end, ["chr", "_n"]).select("chr", F.col("_n").alias("stretch"), (F.col("_next") - F.col("_at")).cast("long").alias("span")), "stretches")
    at = lambda column, name: numbered.select("chr", F.col("_at").alias(column), F.col("_n").alias(name))
    placed = edges.where("left < right").join(at("left", "_a"), ["chr", "left"]).join(at("right", "_b"), ["chr", "right"])
    return placed.withColumn("stretch", F.explode(F.sequence("_a", F.col("_b") - 1))).drop("_a", "_b").join(spans, ["chr", "stretch"])


def coalescence_sums(edges: DataFrame, nodes: DataFrame, samples: DataFrame, write) -> DataFrame:
    """chr, stretch, span and sums over pairs of samples that have a common ancestor there: times and numbers of pairs of
    one deme (within) and of all pairs.

    `nodes` has node, time; `samples` node, deme. At one place a child has one parent at most, and parents are older. From
    the tips up, a node's samples by deme are the sums of its children's, and the pairs that meet in it are its pairs less
    those of each child. Tips come to a tree as counts by parent and deme. A tree that has more than TREE_ROWS rows then
    loses its lowest nodes, in as many rounds as it needs, so what a task holds is bounded, and never a pair.
    """
    d = samples.select("deme").distinct()
    demes = write(in_order(d, ["deme"], "_deme"), "demes")
    n_demes = demes.count()
    tips = samples.join(demes, "deme").select(F.col("node").alias("child"), F.col("_deme").cast("int").alias("deme"))
    time = lambda of: nodes.select(F.col("node").alias(of), F.col("time").cast("double").alias(f"{of}_time"))
    timed = edges.where("left < right").select("chr", "left", "right", "parent", "child").join(time("parent"), "parent").join(time("child"), "child").join(tips, "child", "left")
    reached = F.max("right").over(Window.partitionBy("chr", "child").orderBy("left", "right").rowsBetween(Window.unboundedPreceding, -1))
    wrong = F.when(F.col("parent_time") <= F.col("child_time"), "a parent is not older than its child").when(F.col("_reached") > F.col("left"), "a node has two parents at one place")
    checked = timed.withColumn("_reached", reached).withColumn("parent", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("parent").cast("long"))).drop("_reached")
    checked = write(checked, "timed")
    parents = checked.select("chr", F.col("parent").alias("child")).distinct()
    key = ["parent", "parent_time", "child", "child_time", "deme"]
    inner = checked.join(parents, ["chr", "child"], "left_semi").select("chr", "left", "right", *key, F.when(F.col("deme").isNull(), 0).otherwise(1).cast("long").alias("k"))
    none = lambda kind: F.lit(None).cast(kind)
    own = checked.join(parents, ["chr", "child"], "left_anti").withColumns({"child": none(checked.schema["child"].dataType), "child_time": none("double")})
    own = own.groupBy("chr", "left", "right", *key).agg(F.count("deme").alias("k"))
    cut = stretches(inner.unionByName(own), write).groupBy(F.col("chr").cast("int").alias("chr"), "stretch", "span", *key).agg(F.sum("k").alias("k"))
    cut, raked = write(cut, "trees"), None
    most = min(TREE_ROWS, TREE_CELLS // max(1, n_demes))
    while _largest(cut) > most and cut.where("child is not null").limit(1).count():
        cut, done = _rake(cut, write)
        raked = done if raked is None else raked.unionByName(done)
    here = ["chr", "stretch", "span"]
    if _largest(cut) > most:  # roots only
        made = _pairs(cut, [*here, "parent", "parent_time"]).groupBy(*here).agg(F.sum(F.col("parent_time") * F.col("w")).alias("within_time"), F.sum("w").alias("within_pairs"), F.sum(F.col("parent_time") * F.col("e")).alias("all_time"), F.sum("e").alias("all_pairs"))
    else:
        made = _trees(cut, n_demes)
    if raked is None:
        return made
    return made.unionByName(raked).groupBy(*here).agg(*[F.sum(c).alias(c) for c in ("within_time", "within_pairs", "all_time", "all_pairs")])


def _largest(cut: DataFrame) -> int:
    return cut.groupBy("chr", "stretch").count().agg(F.max("count")).first()[0] or 0  # one number


def _pairs(counts: DataFrame, by: list[str]) -> DataFrame:
    """By `by`: pairs of one deme (w) and of all (e) of k samples by deme."""
    k = counts.groupBy(*by, "deme").agg(F.sum("k").cast("double").alias("k")).groupBy(*by)
    return k.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("w"), (F.sum("k") * (F.sum("k") - 1) / 2).alias("e"))


def _rake(cut: DataFrame, write) -> tuple[DataFrame, DataFrame]:
    """Trees without their lowest inner nodes, whose samples become counts of their parents, and sums that make up for it:
    pairs in such a node then count as meeting in its parent, so they get the difference of the two times."""
    at, here = ["chr", "stretch"], ["chr", "stretch", "span"]
    inner, counts = cut.where("child is not null"), cut.where("child is null")
    above = inner.select(*at, F.col("parent").alias("child")).distinct()
    low = write(inner.join(above, [*at, "child"], "left_anti"), "low")
    edge = low.select(*at, "child", "parent", "parent_time", "child_time")
    held = counts.select(*here, F.col("parent").alias("child"), "deme", "k").unionByName(low.select(*here, "child", "deme", "k")).join(edge, [*at, "child"])
    held = write(held, "held")
    node = [*here, "parent", "parent_time", "child", "child_time"]
    later = F.col("child_time") - F.col("parent_time")
    done = _pairs(held, node).groupBy(*here).agg(F.sum(later * F.col("w")).alias("within_time"), F.lit(0.0).alias("within_pairs"), F.sum(later * F.col("e")).alias("all_time"), F.lit(0.0).alias("all_pairs"))
    moved = held.withColumns({"child": F.lit(None).cast(held.schema["child"].dataType), "child_time": F.lit(None).cast("double")}).select(*cut.columns)
    kept = counts.join(low.select(*at, F.col("child").alias("parent")), [*at, "parent"], "left_anti").select(*cut.columns)
    up = kept.unionByName(moved).groupBy(*[c for c in cut.columns if c != "k"]).agg(F.sum("k").alias("k"))
    rest = inner.join(above, [*at, "child"], "left_semi").select(*cut.columns)
    return write(rest.unionByName(up), "trees"), write(done, "raked")


def _trees(cut: DataFrame, n_demes: int) -> DataFrame:
    """The sums of each local tree, a task for each: rows with a child are edges, those without are k tips of the parent."""

    def tree(group: pa.Table) -> pa.Table:
        edge = group.column("child").is_valid().to_numpy()
        group, tips = group.filter(pa.array(edge)), group.filter(pa.array(~edge))
        parent, child, up, down = (group.column(c).to_numpy() for c in ("parent", "child", "parent_time", "child_time"))
        owner = tips.column("parent").to_numpy()
        known, index = np.unique(np.concatenate([parent, child, owner]), return_inverse=True)
        above, below, holds = np.split(index, [len(parent), 2 * len(parent)])
        count, times = np.zeros((len(known), n_demes)), np.zeros(len(known))
        times[above], times[holds] = up, tips.column("parent_time").to_numpy()
        for of, rows in ((below, group), (holds, tips)):
            held = rows.column("deme").is_valid().to_numpy()
            np.add.at(count, (of[held], rows.column("deme").drop_null().to_numpy()), rows.column("k").to_numpy()[held])
        for t in np.unique(down):  # all children of one time are complete, since theirs are younger
            now = down == t
            np.add.at(count, above[now], count[below[now]])
        pairs = lambda k: k * (k - 1) / 2
        within, every = pairs(count).sum(1), pairs(count.sum(1))
        met_within, met = within.copy(), every.copy()
        np.subtract.at(met_within, above, within[below])
        np.subtract.at(met, above, every[below])
        one = group if len(group) else tips
        row = [one.column("chr")[0].as_py(), one.column("stretch")[0].as_py(), one.column("span")[0].as_py(), float(times @ met_within), float(met_within.sum()), float(times @ met), float(met.sum())]
        return pa.table([pa.array([v]) for v in row], names=["chr", "stretch", "span", "within_time", "within_pairs", "all_time", "all_pairs"]).cast(schema)

    schema = pa.schema([("chr", pa.int32()), ("stretch", pa.int64()), ("span", pa.int64()), *[(c, pa.float64()) for c in ("within_time", "within_pairs", "all_time", "all_pairs")]])
    return cut.groupBy("chr", "stretch").applyInArrow(tree, _OUT)


def mrca_fst(sums: DataFrame) -> DataFrame:
    """t_within, t_between and fst = 1 - t_within / t_between: mean times by length of stretches; null without such pairs."""
    total = lambda c: F.sum(F.col("span") * F.col(c))
    all_of = sums.agg(total("within_time").alias("wt"), total("within_pairs").alias("wp"), total("all_time").alias("at"), total("all_pairs").alias("ap"))
    within = F.when(F.col("wp") > 0, F.col("wt") / F.col("wp"))
    between = F.when(F.col("ap") > F.col("wp"), (F.col("at") - F.col("wt")) / (F.col("ap") - F.col("wp")))
    return all_of.select(within.alias("t_within"), between.alias("t_between")).withColumn("fst", F.when(F.col("t_between") > 0, 1 - F.col("t_within") / F.col("t_between")))
