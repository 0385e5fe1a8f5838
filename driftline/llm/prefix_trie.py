"""The prefix trie of conversations: union-find over common prefixes of sorted neighbours, forests of ranges merged at their ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.llm._tables import BROADCAST_BYTES, Scratch

#: Bytes of the digest that stands for a turn in a path.
WIDTH = 16
#: Ids of one block are joined before blocks are; a block spans so many ids.
BLOCK = 4096
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

#: What the forest of a range gives. Finished nodes know their parent, or the open node (`above_spine`) that it is part of.
_FOREST = "conv_id {id}, depth long, parent_conv_id {id}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, spine int, at_start boolean, at_end boolean, size long, above_spine int"
_MERGED = "conv_id {id}, depth long, parent_conv_id {id}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, spine int, is_first boolean"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_paths(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id and `turns`, an array of (digest of role and text, bytes of the text).

    Rows are in order of turn (nulls first), role and the MD5 of the text. Null roles and texts are empty. Texts stay
    where they are read; what comes together is a digest and a length for each turn of one conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    # the role's length keeps roles and texts apart
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col(turn_col).alias("t"), role.alias("r"), F.md5(text).alias("m"), digest.alias("d"), F.octet_length(text).cast("long").alias("b"))
    grouped = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["d"], t["b"])).alias("turns"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """`turn_paths` of rebuilt conversations: the first h turns of conversation c - c % 5, then c's own after its first h.

    h is crc32(c in decimal) % 9. A conversation that is absent gives no turns, one that is shorter all it has. Rows without
    a conversation stay as they are. A conversation is the base of five at most (nine around 0), so the join has no hot key.
    """
    own = turn_paths(rows)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    base = own.select(F.col("conv_id").alias("base"), F.col("turns").alias("first"))
    joined = own.withColumn("h", F.coalesce(h, F.lit(0))).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(base, "base", "left")
    head = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _sequences(paths: DataFrame) -> DataFrame:
    """The distinct paths: path (digests one after the other), sizes, n_convs, conv_id (least), ends (SHA-256 of all ids).

    Equal conversations are counted where they are read, in blocks of ids, then by path. The ids of a path end in one
    string, as its digest needs; nothing else grows with the number of its copies.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), ""))
    rows = paths.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["b"]).alias("sizes"), F.floor(F.col("conv_id") / BLOCK).alias("block"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = rows.groupBy("path", "block").agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), ids.alias("ids"))
    joined = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("block", "ids"))), lambda b: b["ids"] != ""), lambda b: b["ids"]), ",")
    return blocks.groupBy("path").agg(F.first("sizes").alias("sizes"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sha2(joined, 256).alias("ends"))


def common(a: bytes | None, b: bytes | None) -> int:
    """How many turns two paths share from the first on."""
    if a is None or b is None:
        return 0
    k = 0
    while k < len(a) and k < len(b) and a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    return k // WIDTH


class Forest:
    """The trie over sorted distinct paths, contracted to nodes where paths end or part, by union-find.

    Edges join neighbours with the length of their common prefix. Taken in descending length, an edge merges two
    components: it makes a branching node at its depth above their tops, unless one of the tops is that node already.
    """

    def __init__(self, lengths: list[int], shared: np.ndarray):
        """`shared[i]`: common turns of paths i and i + 1."""
        m = len(lengths)
        self.depth, self.children, self.ends = list(lengths), [[] for _ in range(m)], list(range(m))
        link, top = list(range(m)), list(range(m))

        def find(i: int) -> int:
            while link[i] != i:
                link[i] = link[link[i]]
                i = link[i]
            return i

        for i in np.argsort(-shared, kind="stable").tolist():
            a, b, at = find(i), find(i + 1), int(shared[i])
            node = next((t for t in (top[a], top[b]) if self.depth[t] == at), None)
            if node is None:
                node = len(self.depth)
                self.depth.append(at)
                self.children.append([])
                self.ends.append(-1)
            self.children[node].extend(t for t in (top[a], top[b]) if t != node)
            link[b] = a
            top[a] = node
        self.top = top[find(0)]


def _least(found: list) -> int | None:
    return min((c for c in found if c is not None), default=None)


def _range_forest(part: int, rows: list[tuple], left: int, right: int) -> Iterator[tuple]:
    """The nodes of one range of sorted paths (path, sizes, n_convs, conv_id, ends), as rows of _FOREST.

    The root, prefixes of the first path down to depth `left` and of the last down to `right` may be nodes of the ranges
    beside this one too. They are open: their rows hold what this range adds, without what open nodes below them hold.
    Spine 0 has the open prefixes of the first path, spine 1 those of the last path alone.
    """
    paths = [r[0] for r in rows]
    tree = Forest([len(p) // WIDTH for p in paths], np.array([common(a, b) for a, b in zip(paths, paths[1:])], "i8"))
    order, above = [tree.top], {tree.top: None}
    for v in order:
        for c in tree.children[v]:
            above[c] = v
        order.extend(tree.children[v])
    low, high, n, conv = {}, {}, {}, {}
    for v in reversed(order):
        own, kids = tree.ends[v], tree.children[v]
        mine = [own] if own >= 0 else []
        low[v], high[v] = min([*mine, *[low[c] for c in kids]]), max([*mine, *[high[c] for c in kids]])
        n[v] = sum(rows[i][2] for i in mine) + sum(n[c] for c in kids)
        conv[v] = _least([*[rows[i][3] for i in mine], *[conv[c] for c in kids]])

    def is_open(v: int, d: int) -> bool:
        return d == 0 or (low[v] == 0 and d <= left) or (high[v] == len(rows) - 1 and d <= right)

    leaves, saved = {}, {}
    for v in reversed(order):
        kids, at, top = tree.children[v], tree.depth[v], -1 if above[v] is None else tree.depth[above[v]]
        leaves[v], saved[v] = sum(leaves[c] for c in kids), sum(saved[c] for c in kids)
        sizes = rows[low[v]][1]
        for d in range(at, top, -1):
            ends = rows[tree.ends[v]][4] if d == at and tree.ends[v] >= 0 else None
            spine = 0 if low[v] == 0 else 1
            size = sizes[d - 1] if d else 0
            if is_open(v, d):
                kept = sum(not is_open(c, d + 1) for c in kids) if d == at else int(not is_open(v, d + 1))
                yield (conv[v], d, None, n[v], kept, leaves[v], saved[v], ends, part, spine, low[v] == 0, high[v] == len(rows) - 1, size, None)
                leaves[v] = saved[v] = 0
                continue
            saved[v] += (n[v] - 1) * size
            if d == at and not kids:
                leaves[v] = 1
            u = v if d - 1 > top else above[v]
            parent, above_spine = (None, 0 if low[u] == 0 else 1) if is_open(u, d - 1) else (conv[u], None)
            yield (conv[v], d, parent, n[v], len(kids) if d == at else 1, leaves[v], saved[v], ends or EMPTY_SHA, part, None, None, None, size, above_spine)


def _merge(rows: list[dict]) -> list[tuple]:
    """Joins the open nodes of all ranges: union-find over the boundaries between ranges, then sums from the deepest on."""
    at = {(r["part"], r["spine"], r["depth"]): k for k, r in enumerate(rows)}
    link = list(range(len(rows)))

    def find(i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    starts, ends = ({(r["part"], r["depth"]): k for k, r in enumerate(rows) if r[side]} for side in ("at_start", "at_end"))
    parts = sorted({r["part"] for r in rows})
    after = dict(zip(parts, parts[1:]))
    # an open end is as deep as the next range shares it, so what meets has the same prefix; the root is always shared
    for (part, depth), k in ends.items():
        other = starts.get((after.get(part), depth))
        if other is not None and (depth == 0 or depth <= rows[k]["right"]):
            link[find(other)] = find(k)
    groups: dict[int, list[int]] = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    above, kids = {}, {g: [] for g in groups}
    for g in groups:
        r = rows[g]
        if r["depth"]:
            p = at.get((r["part"], r["spine"], r["depth"] - 1))
            above[g] = find(at[r["part"], 0, r["depth"] - 1] if p is None else p)
            kids[above[g]].append(g)
    conv = {g: _least([rows[k]["conv_id"] for k in of]) for g, of in groups.items()}
    total = {}
    for g in sorted(groups, key=lambda g: -rows[g]["depth"]):
        of = [rows[k] for k in groups[g]]
        n, below = sum(r["n_convs"] for r in of), [total[c] for c in kids[g]]
        children = sum(r["n_children"] for r in of) + len(below)
        leaves = sum(r["n_leaves"] for r in of) + sum(t[2] for t in below) if children else 1
        saved = sum(r["saved_tokens"] for r in of) + (n - 1) * of[0]["size"] + sum(t[3] for t in below)
        total[g] = (n, children, leaves, saved, next((r["ends_sha256"] for r in of if r["ends_sha256"]), EMPTY_SHA))
    return [
        (conv[g], rows[g]["depth"], conv[above[g]] if g in above else None, *total[g], rows[k]["part"], rows[k]["spine"], k == of[0])
        for g, of in groups.items() for k in of
    ]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(columns, schema, strict=True)], schema=schema)


def _forests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    names = ["part", "left", "right", "path", "sizes", "n_convs", "conv_id", "ends"]
    held: list[tuple] = []
    key: tuple | None = None
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if row[:3] != key:
                if held:
                    yield _batch(list(_range_forest(key[0], held, key[1], key[2])), schema)
                key, held = row[:3], []
            held.append(row[3:])
    if held:
        yield _batch(list(_range_forest(key[0], held, key[1], key[2])), schema)


def _shared(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("part", "before", "first", "last", "after")], strict=True)
        yield _batch([(part, common(before, first), common(last, after)) for part, before, first, last, after in rows], schema)


def prefix_trie(paths: DataFrame) -> DataFrame:
    """All nodes of the trie of `paths` (conv_id, turns), one row each.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens (over the subtree, the
    node included), ends_sha256 (of the ascending ids of members that end here, joined by commas).

    Distinct paths are sorted by ranges. Each range builds its forest by union-find over the common prefixes of
    neighbours; nodes that a range can share with the next are prefixes of its first or last path, and only those, no
    deeper than they are shared, meet in one task: two spines for each range, whatever the table's size.

    A conversation without turns ends in the root. One without an id is counted, and is the least member of no node that
    has another. A path is held as one row, 16 bytes a turn. An empty table gives no node, not even a root.
    """
    spark, scratch = paths.sparkSession, Scratch(paths.sparkSession)
    kind = paths.schema["conv_id"].dataType.simpleString()
    shapes = {name: T.StructType.fromDDL(text.format(id=kind)) for name, text in (("forest", _FOREST), ("merged", _MERGED), ("limits", "part int, left int, right int"))}
    arrow = {name: to_arrow_schema(shape) for name, shape in shapes.items()}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.write("ranged", _sequences(paths).repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    # one row a range
    beside = Window.orderBy("part")
    beside = ends.select("part", "first", "last", F.lag("last").over(beside).alias("before"), F.lead("first").over(beside).alias("after"))
    limits = scratch.write("limits", beside.mapInArrow(lambda b: _shared(b, arrow["limits"]), shapes["limits"]))
    dealt = ranged.join(F.broadcast(limits), "part").repartitionByRange(parts, "part").sortWithinPartitions("part", "path")
    forest = scratch.write("forest", dealt.mapInArrow(lambda b: _forests(b, arrow["forest"]), shapes["forest"]))
    opened = forest.where("spine is not null").join(F.broadcast(limits), "part").withColumn("all", F.lit(0))
    merged = scratch.write("merged", opened.groupBy("all").applyInArrow(lambda t: pa.Table.from_batches([_batch(_merge(t.to_pylist()), arrow["merged"])]), shapes["merged"]))
    finished = forest.where("spine is null")
    lead = merged.select("part", F.col("spine").alias("above_spine"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("open_conv_id"))
    lead = F.broadcast(lead) if lead.count() * 64 <= BROADCAST_BYTES else lead
    known = finished.join(lead, ["part", "above_spine", "depth"], "left").withColumn("parent_conv_id", F.when(F.col("above_spine").isNull(), F.col("parent_conv_id")).otherwise(F.col("open_conv_id")))
    return known.select(*NODE).unionByName(merged.where("is_first").select(*NODE))


SQL = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) r(i))),
own AS (
  SELECT conv_id, list({'k': md5(length(role) || ':' || role || text), 'b': strlen(text)::BIGINT} ORDER BY turn NULLS FIRST, role, md5(text)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id),
h AS (SELECT own.*, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9, 0) AS h FROM own, tab),
made AS (SELECT h.conv_id, coalesce(base.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns FROM h LEFT JOIN own base ON base.conv_id = h.conv_id - h.conv_id % 5),
pre AS (
  SELECT conv_id, d, array_to_string(list_transform(turns[1:d], lambda x: x.k), '') AS path, CASE WHEN d > 0 THEN turns[d].b ELSE 0 END AS b, len(turns) = d AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM made)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM pre GROUP BY path, d),
kids AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
below AS (SELECT left(path, 32 * up) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n - 1) * b)::BIGINT AS saved FROM (SELECT *, unnest(range(d + 1)) AS up FROM full_node) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN below USING (path) LEFT JOIN node p ON f.d > 0 AND p.path = left(f.path, 32 * (f.d - 1))
"""
