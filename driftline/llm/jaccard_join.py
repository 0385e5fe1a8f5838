"""Exact Jaccard join of shingle sets: pigeonhole over a hash partition of the universe, then exact checks.

Two sets with 100 * |x & y| >= 75 * |x | y| differ in at most (|x| + |y|) / 7 shingles. Hash the universe into m
segments: each differing shingle touches one segment, so among any H + 1 segments one is equal in both. A segment
where one difference is allowed counts twice; it is found through one-deletion neighbourhoods. Which segments a set
probes, and where it allows a difference, is decided by cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm._tables import BROADCAST_BYTES, Scratch

WORDS = 5
PERCENT = 75
#: Documents that are hashed as one numpy buffer, and the bytes after which a buffer ends earlier.
SLICE, SLICE_BYTES = 256, 1 << 20
#: Segments per shingle of a band's largest set, and a few more: nearly every set then fills enough of them.
SEGMENTS_PER_SHINGLE, SEGMENTS_MORE = 0.45, 8
#: Segments of each band that one-deletion neighbourhoods are indexed for.
DELETION_SEGMENTS = 2
#: Sets whose signatures give the costs; a signature that this many of them share is dear.
SAMPLE_SETS, DEAR, DEAR_MOST = 20_000, 4, 200_000
#: Sub-groups that the members of a dear signature are dealt over.
SALTS = 16
#: Members of a group that meet the others as one block, and about how many bytes their sketches may have.
CHUNK, CHUNK_BYTES = 512, 4 << 20
#: Nearest members of a block that each member of a mixed group is compared with first; four times as many in each round.
NEAREST = 1
#: More than any distance of sketches.
FAR = np.iinfo("i8").max
#: Blocks of signatures that are dealt over each shuffle partition.
BLOCKS_PER_PARTITION = 4

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256).astype(U) * U(2) + U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, SLICE_BYTES), base, U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U)
    return _POWERS


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; nulls and texts without words have none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], "u1")[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, "u1")
    # nulls may have bytes below them
    sizes = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    starts = offsets[:-1] - offsets[0]
    inside = ~_SPACE[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[starts] = edges[starts + sizes] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    first = np.flatnonzero(after & (~before | edges))
    last = np.flatnonzero(before & (~after | edges))
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * power[: len(data)], dtype=U)])
    words = _mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(U))
    joined = np.zeros(max(0, len(words) - WORDS + 1), U)
    for k in range(WORDS):
        joined = joined * U(_BASE) + words[k : len(words) - WORDS + 1 + k]
    joined = _mix(joined)
    begin, stop = np.searchsorted(first, starts), np.searchsorted(first, starts + sizes)
    out = []
    for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(joined[a : b - WORDS + 1]))
        elif b > a:
            whole = U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * U(_BASE) + w
            out.append(_mix(np.array([whole], U) + U(1)))
        else:
            out.append(np.zeros(0, U))
    return out


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that are small enough to be hashed as one buffer."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
    at = 0
    while at < batch.num_rows:
        size = max(1, min(SLICE, int(np.searchsorted(np.cumsum(lengths[at : at + SLICE]), SLICE_BYTES, "right"))))
        yield batch.slice(at, size)
        at += size


def class_of(shingles: np.ndarray) -> int:
    """The id that equal sets share: 64 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def bands() -> np.ndarray:
    """Least sizes of the bands: sets that can link are of the same or of neighbouring bands."""
    least = [0, 1]
    while least[-1] < 2**40:
        least.append(max(least[-1] + 1, 4 * (least[-1] - 1) // 3 + 1))
    return np.array(least, "i8")


_BANDS = bands()


def segments_of(band: np.ndarray) -> np.ndarray:
    """How many segments the universe has for a band."""
    return (SEGMENTS_PER_SHINGLE * (_BANDS[band + 1] - 1)).astype("i8") + SEGMENTS_MORE


@dataclass
class Signatures:
    """Rows: the signature, the place of the set it comes from, and whether the set probes with it."""

    value: np.ndarray
    owner: np.ndarray
    probe: np.ndarray
    short: np.ndarray  # sets with too few filled segments: they need another way


def signatures(sets: list[np.ndarray], dear: np.ndarray | None = None) -> Signatures:
    """Signatures of sets, each one in its own band's scheme and in that of the band below.

    Of a pair the smaller set probes and the larger is indexed. In its own scheme a set of n shingles allocates
    thresholds that add up to H + 1, H = (n + 4n/3) / 7: 0 (equal) to the filled segments that are not dear, then 1
    (one difference) to segments with one-deletion neighbourhoods, then 0 to dear ones; -1 (skip) to the rest.
    """
    dear = np.zeros(0, U) if dear is None else dear
    n = np.array([len(s) for s in sets], "i8")
    owner_of = np.flatnonzero(n)
    n = n[owner_of]
    if not len(n):
        none = np.zeros(0, "i8")
        return Signatures(none.astype(U), none, none.astype(bool), none)
    tokens = np.concatenate([sets[k] for k in owner_of])
    owner = np.repeat(np.arange(len(n)), n)
    own_band = np.searchsorted(_BANDS, n, "right") - 1
    most = (n + 4 * n // 3) // 7 + 1  # H + 1
    values, owners, probes, short = [], [], [], np.zeros(0, "i8")
    for lower in (0, 1):
        band = own_band - lower
        m = np.where(band >= 1, segments_of(np.maximum(band, 1)), 0)
        keep = m[owner] > 0
        if not keep.any():
            continue
        t, o = tokens[keep], owner[keep]
        base = np.cumsum(m) - m
        # shingles are sorted, so a segment's shingles are neighbours
        at = base[o] + ((t >> U(32)) * m[o].astype(U) >> U(32)).astype("i8")
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        where, who = at[begin], o[begin]
        mixed = _mix(t + U(_BASE))
        total, size = np.add.reduceat(mixed, begin), np.diff(np.concatenate([begin, [len(t)]]))
        tag = _mix((band[who] * 4_000_037 + where - base[who]).astype(U) + U(7))
        value = _mix(total + tag)
        # one-deletion neighbourhoods of the first segments of a scheme
        single = np.repeat(where - base[who] < DELETION_SEGMENTS, size)
        many = single & np.repeat(size > 1, size)
        gone = _mix(np.repeat(total + tag, size)[many] - mixed[many])
        probe = np.zeros(len(value), bool)
        probe_gone = np.zeros(int(many.sum()), bool)
        if not lower:
            costly = np.zeros(len(value), bool)
            if len(dear):
                spot = np.minimum(np.searchsorted(dear, value), len(dear) - 1)
                costly = dear[spot] == value
            # filled segments of a set in order of cost: cheap ones first, larger ones before smaller
            order = np.lexsort((value, -size, costly, who))
            rank = np.empty(len(value), "i8")
            filled = np.bincount(who, minlength=len(n))
            rank[order] = np.arange(len(value)) - np.repeat((np.cumsum(filled) - filled), filled)
            cheap = np.bincount(who, weights=~costly, minlength=len(n)).astype("i8")
            lack = np.maximum(0, most - np.minimum(cheap, most))
            # a segment of one shingle has no one-deletion neighbourhood: without it nothing is left to share
            can_delete = (where - base[who] < DELETION_SEGMENTS) & (size > 1) & ~costly & (rank < most[who])
            upto = np.bincount(who, weights=can_delete, minlength=len(n)).astype("i8")
            deletes = np.minimum(lack, upto)
            nth = np.cumsum(can_delete) - can_delete
            nth -= nth[np.concatenate([[0], np.flatnonzero(who[1:] != who[:-1]) + 1])].repeat(filled[filled > 0])
            chosen = can_delete & (nth < deletes[who])
            probe = rank < (most - deletes)[who]
            probe_gone = np.repeat(chosen, size)[many]
            short = owner_of[filled + deletes < most]
        values += [value, gone]
        owners += [owner_of[who], owner_of[np.repeat(who, size)[many]]]
        probes += [probe, probe_gone]
    return Signatures(np.concatenate(values), np.concatenate(owners), np.concatenate(probes), short)


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parities of how many shingles fall in each of 2 ** k buckets, two or more to a shingle.

    Each shingle that two sets do not share turns one bit, so sketches differ in no more bits than sets in shingles.
    """
    bits = 64
    while bits < 2 * len(shingles):
        bits *= 2
    return np.packbits(np.bincount((shingles & U(bits - 1)).astype("i8"), minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch over fewer buckets: halves are added until `size` bytes are left."""
    out = np.frombuffer(sketch, "u8")
    while len(out) * 8 > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def distances(na: np.ndarray, a: list[bytes], nb: np.ndarray, b: list[bytes]) -> np.ndarray:
    """For all of a against all of b: how many bits of the sketches differ, FAR where sizes or sketches rule a link out."""
    room = np.minimum(na[:, None], nb[None]) * 100 >= PERCENT * np.maximum(na[:, None], nb[None])
    most = (na[:, None] + nb[None]) * (100 - PERCENT) // (100 + PERCENT)
    out = np.full(room.shape, FAR, "i8")
    for size in {len(x) for x in a}:
        i = np.array([k for k, x in enumerate(a) if len(x) == size])
        for other in {len(x) for x in b}:
            j = np.array([k for k, x in enumerate(b) if len(x) == other])
            if not room[np.ix_(i, j)].any():
                continue
            least = min(size, other)
            x, y = (np.stack([folded(side[k], least) for k in at]) for side, at in ((a, i), (b, j)))
            step = max(1, 4_000_000 // (least * len(j)))
            for at in range(0, len(i), step):
                rows = i[at : at + step]
                bits = np.bitwise_count(x[at : at + step, None] ^ y[None]).sum(2, dtype="i8")
                out[np.ix_(rows, j)] = np.where(room[np.ix_(rows, j)] & (bits <= most[np.ix_(rows, j)]), bits, FAR)
    return out


def nearest(bits: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k smallest entries that are not FAR, as a mask; ties go to the first columns."""
    if bits.shape[1] <= k:
        return bits < FAR
    out = np.zeros(bits.shape, bool)
    np.put_along_axis(out, np.argsort(bits, 1, kind="stable")[:, :k], True, 1)
    return out & (bits < FAR)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, n_shingles, class (the id of its set) and sketch; an empty set has class null."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets(part.column("_text"))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch_of(s) for s in sets], pa.binary())], names=schema.names)

    return _read(docs, id_col, text_col).mapInArrow(run, schema)


def _dear_signatures(docs: DataFrame, rows: int, id_col: str, text_col: str) -> np.ndarray:
    """Signatures that several sets of a bounded sample share: they only steer allocation, results do not depend on them."""
    step = max(1, -(-rows // SAMPLE_SETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = {class_of(s): s for s in shingle_sets(part.column("_text"))}
                found = signatures(list(sets.values()))
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(found.value[found.probe]).view("i8"))], names=["value"])

    sampled = _read(docs, id_col, text_col).where(F.pmod(F.xxhash64("_id", F.length("_text")), F.lit(step)) == 0)
    found = sampled.mapInArrow(run, "value long").groupBy("value").count().where(F.col("count") >= DEAR).orderBy(F.desc("count"), "value").limit(DEAR_MOST)
    return np.sort(np.array([r["value"] for r in found.select("value").collect()], "i8").view(U))


def candidate_groups(docs: DataFrame, dear: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of classes that share a signature and of which at least one probes.

    Rows: gid (odd for a dear signature), members, probes (places in members); or, without gid, a set that needs another way: its class and some of
    its shingles as members. Signatures travel as blocks of numbers, 5 bytes of each besides
    what the block tells; a set that is there many times in a task travels once. Members of a dear signature are dealt
    over SALTS rows with the same gid. Equal groups of a task are given once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = parts * BLOCKS_PER_PARTITION
    shared = spark.sparkContext.broadcast(dear)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = shared.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def blocks_of() -> pa.RecordBatch:
            value, member, probe = (np.concatenate(c) for c in zip(*held, strict=True))
            salted = np.zeros(len(value), U)
            if len(costs):
                hot = costs[np.minimum(np.searchsorted(costs, value), len(costs) - 1)] == value
                salted[hot] = 1 + _mix(member[hot].view(U)) % U(SALTS)
            block = (_mix(value + salted) % U(blocks)).astype("i4")
            order = np.argsort(block, kind="stable")
            block, value, member, probe, salted = block[order], value[order], member[order], probe[order], salted[order]
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            high, low = (value >> U(32)).astype("<u4"), (value & U(0xFF)).astype("u1")
            flags = (probe.astype("u1") << 7 | salted.astype("u1")).astype("u1")
            binary = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), binary(high), binary(low), binary(flags), binary(member)], names=["block", "high", "low", "flags", "member"])

        for batch in batches:
            for part in slices(batch, "_text"):
                sets = {c: s for s in shingle_sets(part.column("_text")) if len(s) and (c := class_of(s)) not in seen}
                seen |= sets.keys()
                if len(seen) > 200_000:
                    seen.clear()
                if not sets:
                    continue
                found = signatures(list(sets.values()), costs)
                held.append((found.value, np.array(list(sets), "i8")[found.owner], found.probe))
                rows += len(found.value)
                if len(found.short):
                    # a set that links with one of n shingles has one of any n / 4 + 1 of them
                    some = [(c, s[: len(s) // 4 + 1]) for c, s in (list(sets.items())[k] for k in np.unique(found.short).tolist())]
                    none = pa.array([b""] * len(some), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([-1] * len(some), pa.int32()), none, none, none, pa.array([np.int64(c).tobytes() + s.tobytes() for c, s in some], pa.binary())], names=["block", "high", "low", "flags", "member"])
                if rows > 300_000:
                    yield blocks_of()
                    rows = 0
        if held:
            yield blocks_of()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, members, flags = [], [], []
        for batch in batches:
            for block, high, low, flag, member in zip(*(batch.column(c).to_pylist() for c in ("block", "high", "low", "flags", "member")), strict=True):
                if block < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([np.frombuffer(member, "<i8")], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.int32()))], names=["gid", "members", "probes"])
                    continue
                fl = np.frombuffer(flag, "u1")
                keys.append(np.frombuffer(high, "<u4").astype(U) << U(32) | np.frombuffer(low, "u1").astype(U) << U(24) | (fl & 0x7F).astype(U) << U(16) | U(block & 0xFFFF))
                members.append(np.frombuffer(member, "<i8"))
                flags.append(fl >> 7 == 1)
        names = ["gid", "members", "probes"]
        if not keys:
            return
        key, member, probe = (np.concatenate(x) for x in (keys, members, flags))
        del keys, members, flags
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(key)]]))
        salted = (key >> U(16)) & U(0xFF) > 0
        keep = np.repeat(size > 1, size) | salted
        key, member, probe = key[keep], member[order][keep], probe[order][keep]
        order = np.lexsort((~probe, member, key))
        key, member, probe = key[order], member[order], probe[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (member[1:] != member[:-1])]) if len(key) else np.zeros(0, bool)
        key, member, probe = key[once], member[once], probe[once]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, "i8")
        seen: set[int] = set()
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            hot = int(key[a]) >> 16 & 0xFF
            if (b - a < 2 or not probe[a:b].any()) and not hot:
                continue
            if hot:
                # the salt and the block are no part of a dear signature
                gid = int(key[a]) >> 24 << 24 | 1
            else:
                # equal groups get one gid, whatever they share
                gid = int.from_bytes(hashlib.blake2b(member[a:b].tobytes() + probe[a:b].tobytes(), digest_size=8).digest(), "little") & ~1
                if gid in seen:
                    continue
                seen.add(gid)
            out.append((gid - 2**64 if gid >= 2**63 else gid, member[a:b], np.flatnonzero(probe[a:b]).astype("i4")))
            if len(out) >= 5000:
                yield _groups_batch(out, names)
                out = []
        if out:
            yield _groups_batch(out, names)

    sent = _read(docs, id_col, text_col).mapInArrow(emit, "block int, high binary, low binary, flags binary, member binary")
    return sent.repartition(blocks, "block").mapInArrow(meet, "gid long, members array<long>, probes array<int>")


def _groups_batch(rows: list[tuple[int, np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    ends = lambda c: pa.array(np.concatenate([[0], np.cumsum([len(r[c]) for r in rows])]).astype("i4"))
    lists = [pa.ListArray.from_arrays(ends(c), pa.array(np.concatenate([r[c] for r in rows]))) for c in (1, 2)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *lists], names=names)


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The least vertex reachable from each vertex of undirected links (a, b): v, root.

    Every round takes the least root among neighbours and then the root's root; it ends when nothing changes.
    """
    both = scratch.write(f"{name}_edges", links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = scratch.write(f"{name}_roots0", both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("root")))
    k = 0
    while True:
        near = both.join(roots.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        step = roots.join(near, "v").select("v", "root", F.least("root", "near").alias("near"))
        jump = roots.select(F.col("v").alias("near"), F.col("root").alias("far"))
        after = scratch.write(f"{name}_roots{k + 1}", step.join(jump, "near").select("v", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("_moved")))
        moved = after.where("_moved").limit(1).count()
        scratch.drop(f"{name}_roots{k}")
        roots, k = after.drop("_moved"), k + 1
        if not moved:
            scratch.drop(f"{name}_edges")
            return roots


def merged(roots: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Roots (v, root) after more links (a, b): the components of their roots, and of vertices that had no link before."""
    of = lambda v: roots.select(F.col("v").alias(v), F.col("root").alias(f"r{v}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(between.where("a <> b"), scratch, name)
    after = roots.join(moved.select(F.col("v").alias("root"), F.col("root").alias("_to")), "root", "left").select("v", F.coalesce("_to", "root").alias("root"))
    return scratch.write(f"{name}_merged", after.union(moved.join(roots, "v", "left_anti").select("v", "root")))


def _pruned(pairs: DataFrame, rep: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes, each once, that sizes and sketches leave room for."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda v: rep.select(F.col("class").alias(v), F.col("n").alias(f"n{v}"), F.col("sketch").alias(f"s{v}"))
    near = pairs.join(side("a").drop("sa"), "a").join(side("b").drop("sb"), "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")).select("a", "b")
    near = near.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = (na + nb) * (100 - PERCENT) // (100 + PERCENT)
            fit = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                least = min(len(x), len(y))
                fit[k] = np.bitwise_count(folded(x, least) ^ folded(y, least)).sum(dtype="i8") <= most[k]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(fit))

    return near.mapInArrow(run, "a long, b long")


def _cross_pairs(mixed: DataFrame, rep: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of different components in groups of (gid, v, root, probe) that sizes and sketches leave room for.

    The members outside a group's largest component meet all members, as blocks of numbers; of a block with
    more than k pairs to a member, each one takes its k nearest by their sketches. A row (null, gid) says that some had more. A group of
    at most CHUNK members comes together in one row, so that its sketches are dealt out once. Members of larger ones are
    dealt to chunks of about CHUNK, fewer where sketches are large, and the chunks of a large group over SALTS tasks.
    """
    counts = mixed.groupBy("gid", "root").agg(F.count(F.lit(1)).alias("_c"))
    largest = counts.groupBy("gid").agg(F.max_by("root", F.struct("_c", "root")).alias("_largest"))
    full = mixed.join(largest, "gid").withColumn("outer", F.col("root") != F.col("_largest")).drop("_largest")
    full = full.join(rep.select(F.col("class").alias("v"), "n", F.octet_length("sketch").alias("_bytes")), "v")
    whole = full.groupBy("gid").agg(((F.count(F.lit(1)) <= CHUNK) & (F.sum("_bytes") <= CHUNK_BYTES)).alias("_whole"))
    # sketches come in when it is known where their rows go
    full, sketches = full.drop("_bytes").join(whole, "gid"), rep.select(F.col("class").alias("v"), "sketch")
    small = full.where("_whole").drop("_whole").join(sketches, "v").groupBy("gid").agg(F.collect_list(F.struct("v", "root", "probe", "n", "sketch", "outer")).alias("m"))
    full = full.where("not _whole").drop("_whole").join(sketches, "v")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum(F.octet_length("sketch")) / CHUNK_BYTES))
    sizes = full.groupBy("gid", "outer").agg(parts.alias("_k"))
    chunks = full.join(sizes, ["gid", "outer"]).withColumn("c", F.pmod(F.xxhash64("v"), F.col("_k"))).groupBy("gid", "outer", "c").agg(F.collect_list(F.struct("v", "root", "probe", "n", "sketch")).alias("m"))
    salts = sizes.where("outer").select("gid", F.least(F.lit(SALTS), F.col("_k")).cast("int").alias("_s"))
    left = chunks.where("outer").join(salts, "gid").select("gid", F.pmod("c", "_s").cast("int").alias("_salt"), "c", "m")
    right = chunks.join(salts, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_salt"), "outer", F.col("c").alias("c2"), F.col("m").alias("m2"))
    blocks = left.join(right, ["gid", "_salt"]).where("not outer or c <= c2").select("gid", "m", "m2", "outer")

    def meet(gid: int, x: pa.StructArray, y: pa.StructArray, outer: bool) -> Iterator[pa.RecordBatch]:
        get = lambda t, c: t.field(c).to_numpy(zero_copy_only=False)
        bits = distances(get(x, "n"), x.field("sketch").to_pylist(), get(y, "n"), y.field("sketch").to_pylist())
        bits[(get(x, "root")[:, None] == get(y, "root")[None]) | ~(get(x, "probe")[:, None] | get(y, "probe")[None])] = FAR
        near = bits < FAR
        if near.sum() > k * sum(bits.shape):
            near = nearest(bits, k)
            if outer:
                near |= nearest(bits.T, k).T
        i, j = np.nonzero(near)
        a, b = get(x, "v")[i], get(y, "v")[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        if near.sum() < (bits < FAR).sum():
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([gid], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, one, other, outer in zip(batch.column("gid").to_pylist(), batch.column("m"), batch.column("m2"), batch.column("outer").to_pylist(), strict=True):
                yield from meet(gid, one.values, other.values, outer)

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, one in zip(batch.column("gid").to_pylist(), batch.column("m"), strict=True):
                outside = one.values.field("outer")
                x = one.values.filter(outside)
                yield from meet(gid, x, x, True)
                yield from meet(gid, x, one.values.filter(pc.invert(outside)), False)

    return small.mapInArrow(run_whole, "a long, b long").union(blocks.mapInArrow(run, "a long, b long"))


def _verified(pairs: DataFrame, docs: DataFrame, rep: DataFrame, scratch: Scratch, name: str, id_col: str, text_col: str) -> DataFrame:
    """The pairs of classes whose sets link, by exact counts. Sets are made again from one document of each class."""
    need = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    need = scratch.write(f"{name}_need", need.join(rep, "class").select("class", F.col("doc").alias("_doc")))
    rows = _read(docs, id_col, text_col)
    small = need.count() * 16 <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(need) if small else need, rows["_id"].eqNullSafe(F.col("_doc"))).select("_text", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                # rows that share an id can have other sets
                made = [(c, s.view("i8")) for c, s in zip(part.column("class").to_pylist(), shingle_sets(part.column("_text")), strict=True) if len(s) and class_of(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in made], pa.int64()), pa.array([s for _, s in made], pa.list_(pa.int64()))], names=["class", "s"])

    sets = scratch.write(f"{name}_sets", rows.mapInArrow(run, "class long, s array<long>"))
    side = lambda v: sets.dropDuplicates(["class"]).select(F.col("class").alias(v), F.col("s").alias(f"s{v}"))
    both = F.size(F.array_intersect("sa", "sb"))
    done = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    out = scratch.write(f"{name}_links", done)
    scratch.drop(f"{name}_sets", f"{name}_need")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of 5-word shingles link: id, n_shingles, component_id.

    Equal sets are one class. Classes that share a signature are candidates: first each one with one probing class of
    its group, then, in rounds, members of groups that still hold several components with their nearest members of other
    components, until none has more of them. Sketches rule most pairs out before sets are fetched. Copies are never
    paired with each other, nor are members of one component.

    Null texts and texts without words have no shingles and link with nothing: component_id is their own id, as for
    any document without links. Ids that repeat are rows of their own; component_id is the least id of the component,
    and a null id counts as larger than any other. An empty table gives an empty result; other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    own = scratch.write("own", document_sets(docs, id_col, text_col).withColumnRenamed(id_col, "_doc"))
    rep = scratch.write("rep", own.where("class is not null").groupBy("class").agg(F.min("_doc").alias("doc"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")))
    dear = _dear_signatures(docs, own.count(), id_col, text_col)
    found = scratch.write("groups", candidate_groups(docs, dear, id_col, text_col))
    groups = scratch.write("distinct", found.where("gid is not null").dropDuplicates(["gid", "members"]))
    extra = _short_pairs(docs, found.where("gid is null"), id_col, text_col)

    pivot = F.when(F.size("probes") > 0, F.get("members", F.get("probes", F.lit(0)))).otherwise(F.get("members", F.lit(0)))
    stars = groups.select("gid", pivot.alias("a"), "members")
    heads = stars.groupBy("gid").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").join(stars.select("gid", "a"), "gid").select("a", "b")
    pairs = scratch.write("pairs", _pruned(stars.select("a", F.explode("members").alias("b")).union(heads).union(extra), rep))
    links = _verified(pairs, docs, rep, scratch, "first", id_col, text_col)
    roots = components(links, scratch, "first")

    # what was compared with all its group is done; in a dear group it was compared with its row of the group
    members = groups.select("gid", pivot.alias("_a"), F.posexplode("members").alias("_i", "v"), "probes")
    members = members.where("gid & 1 = 1 or v <> _a").select("gid", "v", F.array_contains("probes", F.col("_i")).alias("probe"))
    tried, k = pairs, NEAREST
    while True:
        rooted = members.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        several = rooted.groupBy("gid").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.max("probe").alias("_p")).where("_lo < _hi and _p").select("gid")
        mixed = scratch.write(f"mixed{k}", rooted.join(several, "gid").select("gid", "v", "root", "probe"))
        found = scratch.write(f"near{k}", _cross_pairs(mixed, rep, k))
        fresh = scratch.write(f"fresh{k}", found.where("a is not null").distinct().join(tried, ["a", "b"], "left_anti"))
        roots = merged(roots, _verified(fresh, docs, rep, scratch, f"more{k}", id_col, text_col), scratch, f"more{k}")
        # groups without such a row have no other pair of different components
        left = scratch.write(f"left{k}", found.where("a is null").select(F.col("b").alias("gid")).distinct())
        if not left.limit(1).count():
            break
        members, tried, k = members.join(left, "gid", "left_semi"), tried.union(fresh), 4 * k

    least = rep.join(roots.withColumnRenamed("v", "class"), "class", "left").select("class", F.coalesce("root", "class").alias("root"), "doc")
    ids = least.groupBy("root").agg(F.min("doc").alias("component_id"))
    of = least.join(ids, "root").select("class", "component_id")
    out = own.join(of, "class", "left")
    return out.select(F.col("_doc").alias(id_col), "n_shingles", F.when(F.col("class").isNull(), F.col("_doc")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that `near_duplicates` finds no links of, and of each component the row of least id.

    Rows with one id and different texts are told apart by their texts' hashes, the smaller one first; a null id is
    smaller than any other. Rows that repeat id and text are one document: they stay or go together.
    """
    keyed = docs.withColumn("_near_row", F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash")))
    found = near_duplicates(keyed, "_near_row", text_col)
    lost = found.where("component_id <> _near_row").select(F.col("_near_row").alias("_near_lost")).distinct()
    return keyed.join(lost, keyed["_near_row"].eqNullSafe(F.col("_near_lost")), "left_anti").drop("_near_row")


def _short_pairs(docs: DataFrame, short: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Candidates of the sets that fill too few segments, another exact way: some of their shingles are looked up in
    all sets. Pairs (a, b) of classes."""
    spark = docs.sparkSession
    short = short.select(F.get("members", F.lit(0)).alias("a"), F.explode(F.slice("members", 2, 2**30)).alias("x")).distinct()
    count = short.count()
    if not count:
        return spark.createDataFrame([], "a long, b long")
    wanted = None
    if count * 16 <= BROADCAST_BYTES:
        wanted = spark.sparkContext.broadcast(np.sort(np.array([r["x"] for r in short.select("x").distinct().collect()], "i8").view(U)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = []
                for s in shingle_sets(part.column("_text")):
                    if len(s) and len(hit := s[np.isin(s, wanted.value)] if wanted else s):
                        rows.append((class_of(s), hit.view("i8")))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], names=["b", "s"])

    found = _read(docs, id_col, text_col).mapInArrow(look, "b long, s array<long>").select("b", F.explode("s").alias("x"))
    return short.join(found, "x").select("a", "b").distinct()
