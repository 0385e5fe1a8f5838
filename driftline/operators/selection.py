"""Scoped Bulmer factors and marginal correlations under sign flips, and the tests that read selection from them.

A scope says which pairs of different trait sites count: the genome, one chromosome ("within"), or a window on it, of
pairs at most half its length apart. Covariances of sites come as tiles; a permutation flips signs of effects, so its
sums are products of tiles with signs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.operators import gram
from driftline.sources import state

#: Least deviation of a site's null, least count of sites with one, and least count of permutations for a test.
LEAST_SD, LEAST_SITES, LEAST_POINTS = 1e-15, 5, 5


def scope_name(percent: float) -> str:
    """win_5pct for 5, win_2p5pct for 2.5."""
    return f"win_{f'{percent:g}'.replace('.', 'p')}pct"


def block_key(block_bp: int, chr_len: int) -> Column:
    """The name of a site's block of `block_bp` positions on its chromosome; positions past the last one are in it."""
    most = max(1, -(-chr_len // block_bp)) - 1
    return F.concat_ws(":", "chr", F.least(F.floor((F.greatest(F.col("bp"), F.lit(1)) - 1) / block_bp), F.lit(most)).cast("long"))


def sign_row(key: object, n_perm: int, seed: int) -> np.ndarray:
    """The signs of a site or block: 1 for the observation, then those of `rng.sign(seed, key, perm)`."""
    flips = [1] + [1 if hashlib.md5(f"{seed}:{key}:{b}".encode()).hexdigest()[0] < "8" else -1 for b in range(1, n_perm + 1)]
    return np.array(flips, "i1")


def _sides(places: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """A row for each tile: its sites in order with their keys, and the signs of each site as bits.

    Signs are drawn once for each key, dealt evenly over tasks: they cost more than their bytes tell.
    """
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            bits = [np.packbits(sign_row(k, n_perm, seed) > 0).tobytes() for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(bits, pa.binary())], names=["key", "bits"])

    keyed = places.withColumn("key", F.col("key").cast("string"))
    drawn = keyed.select("key").distinct().repartition(parts, "key").mapInArrow(draw, "key string, bits binary")
    site = F.struct("at", F.col("chr").cast("int").alias("chr"), F.col("bp").cast("int").alias("bp"), F.col("alpha").cast("double").alias("alpha"), F.col("p").cast("double").alias("p"), "key", "bits")
    rows = keyed.join(drawn, "key").groupBy("tile").agg(F.array_sort(F.collect_list(site)).alias("_s"))
    return rows.select("tile", *[F.col(f"_s.{c}").alias(c) for c in ("chr", "bp", "alpha", "p", "key", "bits")])


class _Tile:
    """Partner sums of the sites of one tile, for each scope and permutation; tiles beside it come one after another."""

    def __init__(self, row: dict, n_perm: int, scopes: list[tuple[str, float | None]]):
        self.n_perm, self.scopes, self.side = n_perm, scopes, _Side(row, "a", n_perm)
        self.sums = [np.zeros((len(self.side.alpha), n_perm + 1)) for _ in scopes]
        self.totals: list[np.ndarray] | None = None
        self.variances = np.zeros(len(self.side.alpha))

    def add(self, r: np.ndarray, other: _Side, own: bool, q: np.ndarray | None = None) -> None:
        """Adds a tile of covariances; with correlations q partner sums are of these, and covariances only make totals."""
        mine = self.side
        w = r[: len(mine.alpha), : len(other.alpha)] * mine.alpha[:, None] * other.alpha[None]
        if own:
            self.variances = w.diagonal().copy()
            w = w - np.diag(self.variances)
        same = mine.chr[:, None] == other.chr[None]
        distance = np.abs(mine.bp[:, None] - other.bp[None])
        scale = mine.alpha[:, None] * other.alpha[None]
        partners = w if q is None else q[: len(mine.alpha), : len(other.alpha)] * scale * (1 - np.eye(len(mine.alpha)) if own else 1)
        if q is not None and self.totals is None:
            self.totals = [np.zeros(self.n_perm + 1) for _ in self.scopes]
        # sites that share their signs are one column of the product
        flipped = lambda kept: (kept if other.plain else kept @ other.members) @ other.signs
        for k, (name, reach) in enumerate(self.scopes):
            mask = 1 if name == "genome" else same if reach is None else same & (distance <= reach)
            kept = partners * mask
            if kept.any():
                self.sums[k] += flipped(kept)
            if self.totals is not None:
                self.totals[k] += (mine.signs[mine.of] * flipped(w * mask)).sum(0)

    def rows(self) -> Iterator[tuple]:
        """For each scope and permutation: sums over sites of b, d and the moments of x and y."""
        mine = self.side
        e = mine.signs[mine.of].astype("f8")
        y0 = np.clip(np.where(mine.alpha > 0, mine.p, 1 - mine.p), 0.005, 0.995)
        y = np.where(e > 0, y0[:, None], 1 - y0[:, None])
        d = (e * (mine.alpha * mine.p)[:, None]).sum(0)
        for n_scope, (sums, (name, _)) in enumerate(zip(self.sums, self.scopes, strict=True)):
            b = e * sums
            total = b.sum(0) if self.totals is None else self.totals[n_scope]
            sd = b[:, 1:].std(axis=1, ddof=1) if self.n_perm > 1 else np.zeros(len(b))
            known = sd >= LEAST_SD
            x, z = b[known] / sd[known, None], y[known]
            moments = (x.sum(0), z.sum(0), (x * x).sum(0), (z * z).sum(0), (x * z).sum(0))
            for k in range(self.n_perm + 1):
                yield (name, k, len(b), float(self.variances.sum()), int(known.sum()), *(float(m[k]) for m in moments), float(total[k]), float(d[k]))


class _Side:
    """The sites of one tile: where they are, their effects and frequencies, and the signs of their distinct keys."""

    def __init__(self, row: dict, mark: str, n_perm: int):
        self.chr, self.bp = (np.array(row[f"{c}_{mark}"], "i8") for c in ("chr", "bp"))
        self.alpha, self.p = (np.array(row[f"{c}_{mark}"], "f8") for c in ("alpha", "p"))
        keys = row[f"key_{mark}"]
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        self.of = np.array([number[k] for k in keys])
        self.plain = len(number) == len(keys)
        first = {k: i for i, k in reversed(list(enumerate(keys)))}
        bits = np.frombuffer(b"".join(row[f"bits_{mark}"][first[k]] for k in number), "u1").reshape(len(number), -1)
        self.signs = np.unpackbits(bits, axis=1, count=n_perm + 1) * 2.0 - 1.0
        self.members = None if self.plain else np.eye(len(number))[self.of]


_SUMS = "scope string, perm int, n long, va double, n_x long, x double, y double, xx double, yy double, xy double, b double, d double"


def sign_flip_points(geno: DataFrame, sites: DataFrame, windows: tuple[float, ...], chr_len: int, n_perm: int, seed: int = 1, block_bp: int | None = None, correlation: bool = False) -> DataFrame:
    """scope, perm, n_loci, va, b, rho, dir: the observation (perm 0) and each sign-flip permutation in each scope.

    b is the off-diagonal sum over single-site variances; rho correlates studentized marginal effects with polarized
    frequencies over sites that have a null deviation (null with fewer than five); dir sums effects times frequencies.
    With `block_bp` the sites of a block of positions share their signs; with `correlation` marginal effects are of
    correlations within demes, so common and rare partners weigh alike. With fewer than three sites there are no rows.

    Covariances of sites come as tiles (`gram.products`). Permutations of a tile's sites are products of its row of tiles
    with signs, scopes are masks in a tile, and what leaves a task is a few sums for each scope and permutation. With
    blocks a tile is first added up to one column a block.
    """
    cells = gram.within_demes(geno, sites)
    used = sites.join(cells.select("slot").distinct(), "slot", "left_semi").withColumn("key", F.col("slot") if block_bp is None else block_key(block_bp, chr_len))
    places = state.written(gram.numbered(used), "places")
    sides = state.written(_sides(places, n_perm, seed), "sides")
    made = gram.products(cells, places, state.written)
    if correlation:
        also = gram.products(gram.within_demes(geno, sites, True), places, state.written)
        made = made.join(also.withColumnRenamed("content", "also"), ["a", "b"], "left")
    made = state.written(made, "products")
    contents = [c for c in made.columns if c in ("content", "also")]
    marked = lambda m: sides.withColumnsRenamed({c: f"{c}_{m}" for c in sides.columns if c != "tile"} | {"tile": m})
    turned = made.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), *contents, F.lit(True).alias("turned"))
    both = made.withColumn("turned", F.lit(False)).unionByName(turned).join(marked("a"), "a").join(marked("b"), "b")
    scopes: list[tuple[str, float | None]] = [("genome", None), ("within", None), *[(scope_name(w), w / 100 * chr_len / 2) for w in windows]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, now = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*tile.rows(), strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c not in contents}
                if row["a"] != now:
                    if tile is not None:
                        yield told()
                    now, tile = row["a"], _Tile(row, n_perm, scopes)
                found = [np.frombuffer(batch.column(c)[k].as_buffer(), "f8").reshape(size, size) for c in contents]
                r, q = ([r.T if row["turned"] else r for r in found] + [None])[:2]
                tile.add(r, _Side(row, "b", n_perm), row["a"] == row["b"], q)
        if tile is not None:
            yield told()

    schema, size = to_arrow_schema(T.StructType.fromDDL(_SUMS)), gram.TILE
    parts = int(geno.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = both.repartitionByRange(parts, "a").sortWithinPartitions("a", "b").mapInArrow(run, _SUMS)
    names = [c for c in sums.columns if c not in ("scope", "perm")]
    total = sums.groupBy("scope", "perm").agg(*[F.sum(c).alias(c) for c in names]).where("n >= 3")
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / F.col("n_x"), F.col("yy") - F.col("y") * F.col("y") / F.col("n_x")
    rho = F.when((F.col("n_x") >= LEAST_SITES) & (vx > 0) & (vy > 0), (F.col("xy") - F.col("x") * F.col("y") / F.col("n_x")) / F.sqrt(vx * vy))
    return total.select("scope", "perm", F.col("n").alias("n_loci"), "va", (F.col("b") / F.col("va")).alias("b"), rho.alias("rho"), F.col("d").alias("dir"))


def selection_tests(points: DataFrame, axis: str = "within", level: float = 0.05) -> DataFrame:
    """A row for each scope of `sign_flip_points`: B and rho with their p, the gate over (B of `axis`, rho, dir), the
    plane and the line over (rho, dir), and classes from them.

    One-sided p of B counts permutations not above it; other p are two-sided about the null's mean. The gate's p counts
    permutations that reach the observation along its direction, all axes standardized by the null. Without rho, or with
    fewer than five permutations that have one, its tests are null and the class is neutral.
    """
    on = points.where(F.col("scope") == axis).select("perm", F.col("b").alias("a"))
    full = points.join(on, "perm")
    null = full.where("perm > 0")
    known = lambda c: F.when(F.col("rho").isNotNull(), F.col(c))
    moments = null.groupBy("scope").agg(
        F.count("rho").alias("_n"), F.avg("a").alias("_ma"), F.stddev_samp("a").alias("_sa"), F.avg("rho").alias("_mr"), F.stddev_samp("rho").alias("_sr"), F.avg("dir").alias("_md"), F.stddev_samp("dir").alias("_sd"),
        F.avg(known("dir")).alias("_kd"), F.var_samp("rho").alias("_vr"), F.var_samp(known("dir")).alias("_vd"), F.covar_samp("rho", known("dir")).alias("_c"),
    )
    ridge = 1e-8 * (F.col("_vr") + F.col("_vd"))
    moments = moments.withColumns({"_rr": F.col("_vr") + ridge, "_dd": F.col("_vd") + ridge})
    moments = moments.withColumn("_det", F.col("_rr") * F.col("_dd") - F.col("_c") * F.col("_c"))
    seen = full.where("perm = 0").select("scope", "n_loci", "va", F.col("b").alias("_b"), F.col("a").alias("_a"), F.col("rho").alias("_rho"), F.col("dir").alias("_dir"))
    one = seen.join(moments, "scope")  # a row a scope

    fit = (F.col("_n") >= LEAST_POINTS) & (F.col("_sa") > 1e-30) & (F.col("_sr") > 1e-30) & (F.col("_sd") > 1e-30)
    z = lambda v, m, s: F.when(fit, (F.col(v) - F.col(m)) / F.col(s))
    one = one.withColumns({"_za": z("_a", "_ma", "_sa"), "_zr": z("_rho", "_mr", "_sr"), "_zd": z("_dir", "_md", "_sd")})
    one = one.withColumn("gate", F.sqrt(F.pow("_za", 2) + F.pow("_zr", 2) + F.pow("_zd", 2))).withColumn("line", (F.col("_zr") + F.col("_zd")) / F.sqrt(F.lit(2.0)))

    def plane(r: Column, d: Column) -> Column:
        r, d = r - F.col("_mr"), d - F.col("_kd")
        return F.when((F.col("_n") >= LEAST_POINTS) & (F.col("_det") > 1e-30), (F.col("_dd") * r * r - 2 * F.col("_c") * r * d + F.col("_rr") * d * d) / F.col("_det"))

    one = one.withColumn("plane", plane(F.col("_rho"), F.col("_dir")))
    each = null.select("scope", "b", "a", "rho", "dir").join(F.broadcast(one), "scope")
    each = each.withColumns({"_ya": z("a", "_ma", "_sa"), "_yr": z("rho", "_mr", "_sr"), "_yd": z("dir", "_md", "_sd"), "_plane": plane(F.col("rho"), F.col("dir"))})
    along = F.col("_ya") * F.col("_za") + F.col("_yr") * F.col("_zr") + F.col("_yd") * F.col("_zd")
    share = lambda hit, of: F.when(F.count(of) > 0, (1 + F.count_if(hit)) / (1 + F.count(of)))
    tests = each.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_perm"),
        share(F.col("b") <= F.col("_b"), F.col("b")).alias("b_p"),
        ((1 + F.count_if(F.abs(F.col("rho") - F.col("_mr")) >= F.abs(F.col("_rho") - F.col("_mr")))) / (1 + F.count(F.lit(1)))).alias("_rho_p"),
        share(along >= F.col("gate") * F.col("gate"), along).alias("gate_p"),
        share(F.col("_plane") >= F.col("plane"), F.when(F.col("plane").isNotNull(), F.col("_plane"))).alias("plane_p"),
        share(F.abs((F.col("_yr") + F.col("_yd")) / F.sqrt(F.lit(2.0))) >= F.abs("line"), F.when(F.col("line").isNotNull(), F.col("_yr") + F.col("_yd"))).alias("line_p"),
        share(F.abs(F.col("dir") - F.col("_md")) >= F.abs(F.col("_dir") - F.col("_md")), F.col("dir")).alias("dir_p"),
    )
    out = one.join(tests, "scope")
    sign = F.when(F.coalesce("line", F.col("_rho") + F.col("_dir")) >= 0, "directional+").otherwise("directional-")
    label = F.when(F.coalesce("gate_p", F.lit(1.0)) >= level, "neutral").when(F.coalesce("plane_p", F.lit(1.0)) >= level, "stabilizing").otherwise(sign)
    dir_z = (F.col("_dir") - F.col("_md")) / F.when(F.col("_sd") > 1e-30, F.col("_sd"))
    by_dir = F.when((F.col("dir_p") < level) & dir_z.isNotNull(), F.when(dir_z >= 0, "directional+").otherwise("directional-")).otherwise("neutral")
    return out.select(
        "scope", "n_loci", "n_perm", "va", F.col("_b").alias("b"), "b_p", F.col("_rho").alias("rho"), F.col("_mr").alias("rho_mean"), F.col("_sr").alias("rho_sd"),
        ((F.col("_rho") - F.col("_mr")) / F.when(F.col("_sr") > 1e-30, F.col("_sr"))).alias("rho_z"), F.when(F.col("_rho").isNotNull() & (F.col("_n") > 0), F.col("_rho_p")).alias("rho_p"),
        "gate", "gate_p", F.sqrt(F.pow("_zr", 2) + F.pow("_zd", 2)).alias("radial"), "plane", "plane_p", "line", "line_p", F.col("_dir").alias("dir"), dir_z.alias("dir_z"), "dir_p", label.alias("class"), by_dir.alias("class_dir"),
    )


def every_scope(tests: DataFrame, sites: DataFrame, windows: tuple[float, ...]) -> DataFrame:
    """`selection_tests` with a row for each scope there is: without enough sites a scope has their number, no permutations,
    null statistics and neutral classes."""
    scopes = ["genome", "within", *map(scope_name, windows)]
    named = sites.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.array(*map(F.lit, scopes))).alias("scope"), "_n")
    full = named.join(tests, "scope", "left")
    return full.withColumns({"n_loci": F.coalesce("n_loci", "_n"), "n_perm": F.coalesce("n_perm", F.lit(0)), "class": F.coalesce("class", F.lit("neutral")), "class_dir": F.coalesce("class_dir", F.lit("neutral"))}).drop("_n")
