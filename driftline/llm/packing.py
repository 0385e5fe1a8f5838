"""Best-fit packing of documents into sequences by bin completion over the histogram of piece lengths."""

from __future__ import annotations

import hashlib
import logging
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm._tables import Scratch
from driftline.llm.bpe import encoder, texts_of

LENGTH = 1024
END_ID = 2
#: Steps of the search for a filling of least waste around one largest piece, which orders the branches.
TRIES = 2_000
#: Steps of the search for a packing: fillings tried and nodes visited. Then the best packing so far is kept.
STEPS = 200_000
#: Parts that the rows of one length are dealt over to be numbered.
PARTS = 256
LOG = logging.getLogger(__name__)


def pieces(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Encodes documents, ends each with `end_id` and cuts those longer than `length`; the first piece is the shorter.

    One row per piece: id, piece, start, length, ids_crc32. Null texts count as empty: their one piece is the end id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind = docs.schema[id_col].dataType
    names = ["piece", "start", "length", "ids_crc32"]
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in names[1:]]])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            for at, texts in texts_of(batch, "_text"):
                rows: list[list[int]] = []
                for k, ids in enumerate(own.encode(texts)):
                    ids, stop = ids + end, 0
                    n = len(ids) // 4
                    for piece, start in enumerate([0, *range(n % length or length, n, length)]):
                        stop = min(n, start + length if piece or not n % length else n % length)
                        rows.append([k, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])])
                table = np.array(rows, "i8")
                columns = [batch.column("_id").slice(at, len(texts)).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype("i4")), *[pa.array(table[:, c]) for c in (2, 3, 4)]]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *names])

    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(run, schema)


def least_sequences(counts: np.ndarray, length: int = LENGTH) -> int:
    """No packing needs fewer: pieces above half a sequence never share one, and volume (all thresholds of Martello and Toth)."""
    half = length // 2
    n, volume = np.cumsum(counts), np.cumsum(counts * np.arange(length + 1))
    small = np.arange(half + 1)  # pieces shorter than this are left out; those above `length` less this stand alone
    alone, large = n[length] - n[length - small], n[length - small] - n[half]
    free = large * length - (volume[length - small] - volume[half])
    rest = volume[half] - np.concatenate([[0], volume[:half]]) - free
    return int((alone + large + np.maximum(0, -(-rest // length))).max())


def complete(counts: np.ndarray, largest: int, space: int, tries: int = TRIES) -> tuple[list[tuple[int, int]], int]:
    """A filling of `space` beside one piece of length `largest`, (length, how many) from the longest, and the steps it took.

    It is one of least waste, or the best of the first `tries` steps. Branch and bound over lengths in descending order
    with a best-fit filling as the first incumbent: a branch ends when what it has and all shorter pieces together
    cannot waste less.
    """
    lengths = np.flatnonzero(counts[: min(space, largest) + 1])[::-1]
    lengths = lengths[lengths > 0]
    have = counts[lengths]
    rest = np.concatenate([np.cumsum((lengths * have)[::-1])[::-1], [0]])
    best: list[tuple[int, int]] = []
    waste, left, spent = space, space, tries
    for k, n in zip(lengths.tolist(), have.tolist(), strict=True):  # best fit, longest first
        if take := min(n, left // k):
            best.append((k, take))
            left -= take * k
    waste = left
    ascending = lengths[::-1]

    def search(i: int, left: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal best, waste, spent
        if left < waste:
            best, waste = list(chosen), left
        while waste and i < len(lengths) and spent > 0 and left - rest[i] < waste:
            # the longest length that fits from here on
            i = max(i, len(lengths) - int(np.searchsorted(ascending, left, "right")))
            if i == len(lengths):
                return
            k = int(lengths[i])
            for take in range(min(int(have[i]), left // k), 0, -1):
                spent -= 1
                search(i + 1, left - take * k, [*chosen, (k, take)])
                if not waste or spent <= 0:
                    return
            i += 1

    search(0, space, [])
    return best, tries - spent + 1


def _spread(bits: int, by: int) -> int:
    """Each bit and the `by` bits above it."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def dominated(left: int, filling: list[tuple[int, int]], waste: int) -> bool:
    """Whether a piece that is `left` (bits by length) fits in, alone or in place of pieces that fit where it lay."""
    single = several = 0
    for k, n in filling:
        for _ in range(n):
            several |= (several | single) << k
            single |= 1 << k
    return bool(left & (_spread(several, waste) | (_spread((single | 1) << 1, waste - 1) if waste else 0)))


def fillings(counts: np.ndarray, space: int, slack: int, spend: Callable[[], bool]) -> Iterator[list[tuple[int, int]]]:
    """All fillings of `space` that are not dominated and waste at most `slack`, those of long pieces first.

    They end early when `spend`, called for each step, says so.
    """
    lengths = np.flatnonzero(counts[: space + 1])[::-1]
    lengths = lengths[lengths > 0].tolist()
    have = [int(counts[k]) for k in lengths]
    rest = [0]
    for k, n in zip(lengths[::-1], have[::-1], strict=True):
        rest.append(rest[-1] + k * n)
    rest.reverse()

    def search(i: int, room: int, chosen: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        while i < len(lengths) and room - rest[i] <= slack:
            k = lengths[i]
            for take in range(min(have[i], room // k), 0, -1):
                if not spend():
                    return
                yield from search(i + 1, room - take * k, [*chosen, (k, take)])
            i += 1
        if i == len(lengths) and room <= slack:
            taken = dict(chosen)
            left = sum(1 << k for k, n in zip(lengths, have, strict=True) if n > taken.get(k, 0))
            if not dominated(left, chosen, room):
                yield chosen

    yield from search(0, space, [])


def greedy(counts: np.ndarray, length: int, tries: int) -> list[tuple[dict[int, int], int]]:
    """Takes the filling that `complete` gives for the longest piece left, as often as counts allow; without tries, best fit."""
    left, out = counts.copy(), []
    for largest in range(length, 0, -1):
        while left[largest]:
            left[largest] -= 1
            need = dict(complete(left, largest, length - largest, tries)[0])
            left[largest] += 1
            need[largest] = need.get(largest, 0) + 1
            times = min(int(left[k]) // n for k, n in need.items())
            for k, n in need.items():
                left[k] -= times * n
            out.append((need, times))
    return out


def pack_counts(counts: np.ndarray, length: int = LENGTH, tries: int = TRIES, steps: int = STEPS) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Fillings for all pieces with how often each is used, from counts by length, and a bound no packing goes below.

    Bin completion: a node takes the longest length left and branches over its undominated fillings, each used as often
    as its counts allow, half as often, ... and once; the first child is a filling of least waste. The first incumbent
    is the best of greedy packings from best fit to least waste. A node ends where sequences so far and the bound on
    the rest are not below the incumbent, or where what is left was seen with no more sequences. Nodes are visited by
    discrepancies: first with none, then with one choice that is not the first, with two ... until the incumbent meets
    the bound, all is searched (then the bound returned is the incumbent itself), or `steps` steps are done.
    """
    left = counts.astype("i8")
    bound = least_sequences(left, length)
    made = [greedy(left, length, n) for n in (tries, tries // 10, tries // 100, 0)]
    best, found = min(((sum(times for _, times in f), f) for f in made), key=lambda x: x[0])
    spent = 0
    if best <= bound:
        return found, bound

    def spend() -> bool:
        nonlocal spent
        spent += 1
        return spent <= steps

    def children(left: np.ndarray, used: int) -> Iterator[tuple[dict[int, int], int]]:
        nonlocal spent
        largest = int(np.flatnonzero(left)[-1])
        beside = left.copy()
        beside[largest] -= 1
        first, took = complete(beside, largest, length - largest, tries)
        spent += took

        def ways(filling: list[tuple[int, int]]) -> Iterator[tuple[dict[int, int], int]]:
            need = dict(filling)
            need[largest] = need.get(largest, 0) + 1
            times = min(int(left[k]) // n for k, n in need.items())
            while times:
                yield need, times
                times //= 2

        yield from ways(first)
        # what may be wasted in all if the rest is to take fewer sequences than the incumbent
        slack = (best - 1 - used) * length - int((left * np.arange(length + 1)).sum())
        for filling in fillings(beside, length - largest, slack, spend):
            if filling != first:
                yield from ways(filling)

    allowed = 0
    while True:
        cut, seen = False, {}
        stack = [(children(left, 0), left, 0, allowed, [0])]
        trail: list[tuple[dict[int, int], int]] = []
        while stack:
            options, here, used, allow, count = stack[-1]
            if spent >= steps:
                return found, bound
            if count[0] and not allow:
                cut = True
                step = None
            else:
                step = next(options, None)
            if step is None:
                stack.pop()
                if trail:
                    trail.pop()
                continue
            need, times = step
            allow -= bool(count[0])
            count[0] += 1
            spent += 1
            after, total = here.copy(), used + times
            for k, n in need.items():
                after[k] -= times * n
            if not after.any():
                if total < best:
                    best, found = total, [*trail, step]
                    if best <= bound:
                        return found, bound
                continue
            if total + least_sequences(after, length) >= best:
                continue
            key = hashlib.blake2b(after.tobytes(), digest_size=16).digest()
            if any(u <= total and a >= allow for u, a in seen.get(key, ())):
                continue
            seen.setdefault(key, []).append((total, allow))
            trail.append(step)
            stack.append((children(after, total), after, total, allow, [0]))
        if not cut:
            return found, bound if spent >= steps else best
        allowed += 1


def plan(counts: np.ndarray, length: int = LENGTH, tries: int = TRIES, steps: int = STEPS) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces, from counts by length: rows (length, first, times, sequence, offset, each).

    Row: the pieces of this length numbered `first`, ... go to sequences `sequence`, ..., each one at `offset` and
    those after it, `each` to a sequence, over `times` sequences. The work depends on how many lengths there are, at
    most `length`, and hardly on how many pieces. How many sequences more than the bound there are is logged.
    """
    used = np.zeros_like(counts, "i8")
    rows, sequence = [], 0
    found, bound = pack_counts(counts, length, tries, steps)
    for need, times in found:
        at = 0
        for k, n in sorted(need.items(), reverse=True):
            rows.append((k, int(used[k]), times, sequence, at, n))
            used[k] += times * n
            at += k * n
        sequence += times
    LOG.info("%d sequences, %d more than the bound of %d", sequence, sequence - bound, bound)
    return rows


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds `_number`, from 0 within each length: parts of a length are counted, then numbered side by side."""
    order = [c for c in rows.columns if not c.startswith("_")]
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int")
    rows = rows.withColumn("_part", part)
    # at most `length` x PARTS rows
    sizes = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.aggregate(F.filter("_all", lambda x: x["_part"] < F.col("_one._part")), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    bases = sizes.groupBy("length").agg(F.collect_list(F.struct("_part", "_n")).alias("_all")).select("length", "_all", F.explode("_all").alias("_one")).select("length", F.col("_one._part").alias("_part"), before.alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order))
    return rows.join(F.broadcast(bases), ["length", "_part"]).withColumn("_number", F.col("_base") + within - 1).drop("_part", "_base")


def pack(parts: DataFrame, length: int = LENGTH, tries: int = TRIES) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` from 1 to `length`, in as few sequences as it finds.

    The driver gets the counts of pieces by length (at most `length` numbers), searches fillings and sends them back;
    pieces are numbered within their length and look their place up. Full pieces are sequences by themselves. Pieces of one length
    are interchangeable, so ties do not matter; rows that repeat are packed each. An empty table gives an empty result.
    Columns named like an output are replaced.
    """
    spark, scratch = parts.sparkSession, Scratch(parts.sparkSession)
    parts = scratch.write("pieces", parts.drop("sequence_id", "offset"))
    full = parts.where(F.col("length") == length)
    rest = parts.where(F.col("length") < length)
    counts = np.zeros(length + 1, "i8")
    for row in rest.groupBy("length").count().collect():  # fewer than `length` rows
        counts[row["length"]] = row["count"]
    schema = "length long, _first long, _times long, _sequence long, _at long, _each long"
    # one row per length: its fillings in order of their first number
    fillings = spark.createDataFrame(plan(counts, length, tries), schema).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_first", "_times", "_sequence", "_at", "_each"))).alias("_f"))
    placed = _numbered(rest).join(F.broadcast(fillings), "length").withColumn("_o", _last_at_most(F.col("_f"), F.col("_number")))
    nth = F.col("_number") - F.col("_o._first")
    packed = placed.withColumn("sequence_id", F.col("_o._sequence") + F.floor(nth / F.col("_o._each")))
    packed = packed.withColumn("offset", F.col("_o._at") + F.col("length") * (nth % F.col("_o._each")))
    # a full piece is a sequence; the written table gives it a number of its own below 0
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.select(*parts.columns, "sequence_id", "offset").unionByName(alone)


def _last_at_most(fillings: Column, number: Column) -> Column:
    """The last filling whose first number is not above `number`, by halving."""
    size = F.size(fillings)
    span = F.aggregate(
        F.sequence(F.lit(1), F.ceil(F.log2(size.cast("double"))).cast("int") + 1),
        F.struct(F.lit(0).alias("lo"), size.alias("hi")),
        lambda a, _: F.when(a["hi"] - a["lo"] <= 1, a).otherwise(
            F.when(F.get(fillings, F.shiftright(a["lo"] + a["hi"], 1))["_first"] <= number, F.struct(F.shiftright(a["lo"] + a["hi"], 1).alias("lo"), a["hi"].alias("hi"))).otherwise(
                F.struct(a["lo"].alias("lo"), F.shiftright(a["lo"] + a["hi"], 1).alias("hi"))
            )
        ),
    )
    return F.get(fillings, span["lo"])


def pack_documents(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Encodes, cuts and packs whole documents: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, spec, id_col, text_col, length, end_id), length)
