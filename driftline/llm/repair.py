"""Token-ID files compressed by a Re-Pair grammar: frequent id pairs become rules, shard by shard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm._tables import BROADCAST_BYTES
from driftline.llm.bpe import encoder, texts_of

END_ID = 2
#: Ids of a block: each has its own rules, and a reader needs one block at a time.
BLOCK_IDS = 500_000
#: Pairs replaced at once (rounds go on until no frequent pair is left), and how often a pair must be there to earn its rule.
PAIRS, LEAST = 1024, 8
#: Slots that pairs are hashed to: those of a slot below LEAST need no exact count.
COUNTER_BITS = 18

U = np.uint64

#: A block of the file: where it is, the first nonterminal, rules, expansion lengths, the sequence and its documents.
BLOCK = "shard int, block int, terminals int, left binary, right binary, expands binary, width int, sequence binary, symbols binary, tokens binary"


def _pack(x: np.ndarray) -> tuple[bytes, int]:
    """Little-endian integers of the least of 2 and 4 bytes that hold them."""
    width = 2 if not len(x) or x.max() < 1 << 16 else 4
    return x.astype(f"<u{width}").tobytes(), width


class Grammar:
    """Rules over ids: symbol terminals + k expands to left[k] right[k]."""

    def __init__(self, terminals: int, left: np.ndarray, right: np.ndarray):
        self.terminals, self.left, self.right = terminals, left, right
        parts: list[np.ndarray] = []
        whole = lambda s: parts[s - terminals] if s >= terminals else np.array([s], "u4")
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            parts.append(np.concatenate([whole(a), whole(b)]))
        #: How many ids each nonterminal stands for, and all expansions one after the other.
        self.lengths = np.array([len(p) for p in parts], "i8")
        self.flat = np.concatenate([*parts, np.zeros(0, "u4")])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def sizes(self, sequence: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(sequence), "i4")
        rule = np.flatnonzero(sequence >= self.terminals)
        out[rule] = self.lengths[sequence[rule] - self.terminals]
        return out

    def expand(self, sequence: np.ndarray) -> np.ndarray:
        """The ids that a sequence of symbols stands for."""
        size = self.sizes(sequence)
        # an id stands for itself, a nonterminal for its part of all expansions
        begin = len(self.flat) + np.arange(len(sequence))
        rule = np.flatnonzero(sequence >= self.terminals)
        begin[rule] = self.starts[sequence[rule] - self.terminals]
        ends = np.cumsum(size, dtype="i8")
        source = np.concatenate([self.flat, sequence.astype("u4")])
        return source[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def slice(self, sequence: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of what a sequence stands for; expansion lengths tell which symbols hold them."""
        ends = np.cumsum(self.sizes(sequence))
        a = int(np.searchsorted(ends, start, "right"))
        b = int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(sequence[a:b])[start - skipped : stop - skipped]


def _by_pair(first: np.ndarray, second: np.ndarray, at: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as numbers, first * base + second, sorted, and the place of each one, ascending within a pair."""
    pair, bits = first.astype("u8") * U(base) + second, int(at.max() if len(at) else 0).bit_length()
    if (base * base).bit_length() + bits > 64:
        order = np.lexsort((at, pair))
        return pair[order], at[order]
    key = np.sort(pair << U(bits) | at.astype("u8"))
    return key >> U(bits), (key & U((1 << bits) - 1)).astype("i8")


def _choose(pairs: np.ndarray, counts: np.ndarray, base: int) -> list[int]:
    """Up to PAIRS of the most frequent pairs that cannot overlap: no right symbol of one is the left symbol of another."""
    lefts: set[int] = set()
    rights: set[int] = set()
    chosen = []
    order = np.lexsort((pairs, -counts))[: 2 * PAIRS]
    for k, a, b in zip(order.tolist(), (pairs[order] // U(base)).tolist(), (pairs[order] % U(base)).tolist(), strict=True):
        if a not in rights and b not in lefts and (a != b or a not in lefts and b not in rights):
            lefts.add(a)
            rights.add(b)
            chosen.append(k)
            if len(chosen) == PAIRS:
                break
    return chosen


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over the documents that end at `ends`: left, right, sequence, symbols of each document.

    Every round replaces the most frequent pairs by nonterminals, all at once where pairs cannot overlap, until no pair
    is there LEAST times; counts are exact, and a pair of equal symbols counts at every other place of a run. A count
    never grows once all its symbols are there, so a round looks only at the places whose pair was frequent in the last
    one or has a new symbol. No pair crosses the end of a document, so each document is a run of symbols.
    """
    n = len(ids)
    sequence = np.append(ids, 0).astype("u4")
    # places of the next and the last living symbol of a document; n stands for none
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1] = n
    before[0] = n
    before[ends[:-1]] = n
    alive, marked = np.ones(n, bool), np.zeros(n + 1, bool)
    at = np.flatnonzero(after[:n] < n)
    left: list[int] = []
    right: list[int] = []
    while len(at):
        base = terminals + len(left)
        first, second = sequence[at], sequence[after[at]]
        if len(at) > 1 << COUNTER_BITS:
            slot = (first * np.uint32(0x9E3779B1) + second) * np.uint32(0x85EBCA6B) >> np.uint32(32 - COUNTER_BITS)
            some = (np.bincount(slot, minlength=1 << COUNTER_BITS) >= LEAST)[slot]
            at, first, second = at[some], first[some], second[some]
        pair, place = _by_pair(first, second, at, base)
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        whole = np.diff(np.append(new, len(pair)))
        frequent = whole >= LEAST
        place = place[np.repeat(frequent, whole)]
        names, whole = pair[new[frequent]], whole[frequent]
        if not len(names):
            break
        starts = np.cumsum(whole) - whole
        counts, skipped = whole.copy(), np.zeros(len(place), bool)
        twins = np.flatnonzero(names // U(base) == names % U(base))
        if len(twins):
            spot = np.concatenate([np.arange(starts[k], starts[k] + whole[k]) for k in twins.tolist()])
            begins = np.concatenate([[True], after[place[spot[:-1]]] != place[spot[1:]]])
            begins[np.cumsum(whole[twins])[:-1]] = True
            nth = np.arange(len(spot)) - np.maximum.accumulate(np.where(begins, np.arange(len(spot)), 0))
            skipped[spot[nth % 2 == 1]] = True
            counts[twins] -= np.add.reduceat(skipped[spot], np.cumsum(whole[twins]) - whole[twins], dtype="i8")
        enough = np.flatnonzero(counts >= LEAST)
        picked = enough[_choose(names[enough], counts[enough], base)]
        if not len(picked):
            break
        symbol = np.zeros(len(names), "u4")
        symbol[picked] = base + np.arange(len(picked))
        of = np.repeat(symbol, whole)
        of[skipped] = 0
        marked[place] = True
        hit = np.flatnonzero(of)
        p = place[hit]
        gone = after[p]
        sequence[p] = of[hit]
        alive[gone] = False
        far = after[gone]
        after[p] = far
        before[far] = p
        marked[before[p]] = True
        marked[n] = False
        at = np.flatnonzero(marked)
        marked[at] = False
        at = at[alive[at] & (after[at] < n)]
        left += (names[picked] // U(base)).tolist()
        right += (names[picked] % U(base)).tolist()
    living = np.flatnonzero(alive)
    return np.array(left, "i8"), np.array(right, "i8"), sequence[living], np.diff(np.concatenate([[0], np.flatnonzero(after[living] == n) + 1]))


def expansion_lengths(terminals: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many ids each nonterminal stands for."""
    out: list[int] = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        out.append((out[a - terminals] if a >= terminals else 1) + (out[b - terminals] if b >= terminals else 1))
    return np.array(out, "i8")


def write_ids(docs: DataFrame, path: str, spec: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encodes whole texts and writes them as compressed blocks in ascending order of id, nulls first.

    Texts are dealt to shards by ranges of ids; a shard is written by one task in blocks of BLOCK_IDS ids, each a row
    of Parquet files at `path` with its rules, expansion lengths, sequence and documents. Null texts count as empty:
    they are the end id alone. Rows that repeat an id follow each other in order of their texts.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([*T._parse_datatype_string(BLOCK).fields, T.StructField("ids", T.ArrayType(kind))])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        terminals = max(own.tokenizer.get_vocab_size(), end_id + 1)
        shard, block = TaskContext.get().partitionId(), 0
        names: list[pa.Array] = []
        held: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            nonlocal block
            n = np.array([len(h) // 4 for h in held], "i8")
            left, right, sequence, symbols = compress(np.frombuffer(b"".join(held), "<u4"), np.cumsum(n), terminals)
            packed, width = _pack(sequence)
            row = [shard, block, terminals, left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), expansion_lengths(terminals, left, right).astype("<u4").tobytes(), width, packed, symbols.astype("<u4").tobytes(), n.astype("<u4").tobytes()]
            ids = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(names))
            names.clear()
            held.clear()
            block += 1
            kinds = [pa.int32() if isinstance(x, int) else pa.binary() for x in row]
            return pa.RecordBatch.from_arrays([*(pa.array([x], k) for x, k in zip(row, kinds, strict=True)), ids], names=schema.names)

        for batch in batches:
            for at, texts in texts_of(batch, "_text"):
                start = 0
                for k, ids in enumerate(own.encode(texts)):
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= BLOCK_IDS:
                        names.append(batch.column("_id").slice(at + start, k + 1 - start))
                        yield done()
                        start, size = k + 1, 0
                if start < len(texts):
                    names.append(batch.column("_id").slice(at + start, len(texts) - start))
        if held:
            yield done()

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    dealt = rows.repartitionByRange(shards, "_id").sortWithinPartitions("_id", "_text")
    dealt.mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Reads the files back: id, start (ids of all documents before it), n_tokens, and ids or, with `digest`, ids_crc32."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["ids"].dataType.elementType
    value = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField(id_col, kind), T.StructField("_at", T.LongType()), T.StructField("n_tokens", T.LongType()), value])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "ids"}
                names = batch.column("ids")[k].values
                u4 = lambda c: np.frombuffer(row[c], "<u4").astype("i8")  # noqa: B023, E731
                grammar = Grammar(row["terminals"], u4("left"), u4("right"))
                sequence = np.frombuffer(row["sequence"], f"<u{row['width']}")
                if not np.array_equal(grammar.lengths, u4("expands")):
                    raise ValueError(f"block {row['shard']}.{row['block']} has wrong expansion lengths")
                n, raw = u4("tokens"), grammar.expand(sequence).astype("<u4", copy=False)
                ends = np.cumsum(n)
                if digest:
                    view = memoryview(raw.tobytes())
                    out = pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(raw.astype("i4")))
                same = lambda c: pa.array(np.full(len(n), row[c], "i4"))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same("shard"), same("block"), names, pa.array(ends - n), pa.array(n), out], names=schema.names)

    # a row for each block: its documents' ids are counted and summed up over the blocks before it
    counted = blocks.select("shard", "block", (F.octet_length("tokens") / 4).cast("long").alias("documents"), "tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [int(np.frombuffer(x, "<u4").sum(dtype="i8")) for x in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("block"), pa.array(totals, pa.int64())], names=["shard", "block", "n"])

    sums = counted.mapInArrow(count, "shard int, block int, n long")
    shards = sums.groupBy("shard").agg(F.sum("n").alias("_n"))
    bases = shards.withColumn("_shard_base", F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).drop("_n")
    within = sums.withColumn("_base", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).drop("n").join(bases, "shard")
    small = within.count() * 24 <= BROADCAST_BYTES
    read = blocks.mapInArrow(run, schema).join(F.broadcast(within) if small else within, ["shard", "block"])
    return read.select(id_col, (F.col("_shard_base") + F.col("_base") + F.col("_at")).alias("start"), "n_tokens", value.name)


def read_document(spark: SparkSession, path: str, wanted: int, start: int = 0, stop: int | None = None, id_col: str = "doc_id") -> list[int]:
    """Ids start to stop of one document: its block alone is read, and of its symbols those that hold them."""
    row = spark.read.parquet(path).where(F.array_contains("ids", F.lit(wanted))).orderBy("shard", "block").first()
    if row is None:
        raise KeyError(wanted)
    u4 = lambda c: np.frombuffer(bytes(row[c]), "<u4").astype("i8")
    k, ends = row["ids"].index(wanted), np.cumsum(u4("symbols"))
    sequence = np.frombuffer(bytes(row["sequence"]), f"<u{row['width']}").astype("i8")[int(ends[k] - u4("symbols")[k]) : int(ends[k])]
    return Grammar(row["terminals"], u4("left"), u4("right")).slice(sequence, start, int(u4("tokens")[k]) if stop is None else stop).tolist()
