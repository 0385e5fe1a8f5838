"""Data source `plink`: genotypes of one SNP-major .bed file, plain or in zstd frames, read by ranges of its bytes.

A `.bed.zst` is the .bed in frames of whole sites (the mark is a frame of its own) with the seek table of zstd's seekable
format at its end: `zstd -d` gives the .bed, and a task reads some frames. Where most cells have no copies it grows with
those that do, and the .bed with individuals times sites.
"""

from __future__ import annotations

import os
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from driftline.sources.plink import CODES, MAGIC
from driftline.operators.ranges import running_sum
from driftline.sources.whole_file import local_path, write_bytes

#: Bytes of genotypes that one task reads, about, and that one batch of cells is made from; bytes of a frame before it is
#: compressed, about, and of the frames that one task expands.
PART_BYTES, STEP_BYTES, FRAME_BYTES, EXPANDED_BYTES = 4 << 20, 64 << 10, 1 << 20, 512 << 20
#: Fixed values of zstd's seekable format: the marks of a skippable frame and of its end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Schemes that the Arrow file systems open by themselves, besides mounted folders.
REMOTE = ("hdfs", "s3", "s3a", "gs", "abfs", "abfss")
CELLS = pa.schema([("row", pa.int64()), ("col", pa.int64()), ("g", pa.int32())])


def can_open(uri: str) -> bool:
    return local_path(uri) is not None or uri.split(":", 1)[0] in REMOTE


def _file(uri: str) -> pa.NativeFile:
    path = local_path(uri)
    if path is not None:
        return pa.OSFile(path, "rb")
    store, at = fs.FileSystem.from_uri(uri.replace("s3a:", "s3:", 1))
    return store.open_input_file(at)


def _wrong_length(size: int, n: int) -> ValueError:
    return ValueError(f"{size} bytes are no whole sites of {n} individuals")


def cells(raw: bytes, first: int, n: int, missing: str) -> Iterator[tuple[np.ndarray, ...]]:
    """row, col, g of the cells with copies, of whole sites from `first` on; missing calls are errors unless kept as -1.

    Bytes of four cells without copies are passed over.
    """
    back = np.zeros(4, "i4")
    for copies, bits in CODES.items():
        back[bits] = copies
    width, whole = -(-n // 4), np.frombuffer(raw, "u1")
    words = np.flatnonzero(whole[: len(whole) // 8 * 8].view("u8") != np.uint64(2**64 - 1))
    some = np.concatenate([(words[:, None] * 8 + np.arange(8)).reshape(-1), np.arange(len(whole) // 8 * 8, len(whole))])
    some = some[whole[some] != 0xFF]
    for at in range(0, max(1, len(some)), STEP_BYTES):
        place = some[at : at + STEP_BYTES]
        g = back[whole[place][:, None] >> np.arange(0, 8, 2, "u1") & 3]
        col = (place % width)[:, None] * 4 + np.arange(4)
        known = (g != 0) & (col < n)
        row, col, g = np.broadcast_to((place // width)[:, None], known.shape)[known] + first, col[known], g[known]
        if missing == "error" and (g < 0).any():
            raise ValueError(f"site {row[g < 0][0]} has a missing call")
        yield row, col, g


def gathered(some: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Cells in batches of STEP_BYTES, about: a batch costs more than the few cells of a frame."""
    held, size = [], 0
    for columns in some:
        held, size = [*held, columns] if len(columns[0]) else held, size + len(columns[0])
        if size >= STEP_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=CELLS)
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=CELLS)


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def seek_table(read_at, size: int, width: int) -> np.ndarray:
    """Place, compressed and whole size of each frame of sites, from the end of a file of `size`; `read_at(place, n)` reads."""
    lacks = ValueError("no frames of SNP-major genotypes with a seek table")
    if size < 17:
        raise lacks
    count, kind, mark = struct.unpack("<IBI", read_at(size - 9, 9))
    start = size - 17 - 8 * count
    if mark != SEEKABLE or kind != 0 or start < 0 or struct.unpack("<II", read_at(start, 8)) != (SKIPPABLE, 8 * count + 9):
        raise lacks
    sizes = np.frombuffer(read_at(start + 8, 8 * count), "<u4").reshape(-1, 2).astype("i8")
    places = np.cumsum(sizes[:, 0]) - sizes[:, 0]
    if count == 0 or sizes[0, 1] != len(MAGIC) or sizes[:, 0].sum() != start or bytes(_zstd().decompress(read_at(0, int(sizes[0, 0])), len(MAGIC))) != MAGIC:
        raise lacks
    if width == 0 or (sizes[1:, 1] % width).any():
        raise ValueError(f"{sizes[1:, 1].sum()} bytes are no whole sites of individuals in {width} bytes")
    return np.column_stack([places, sizes])[1:]


@dataclass
class Sites(InputPartition):
    """Sites from `first` on, or, of a file of frames, the (place, compressed, whole size) of some of its frames."""

    first: int
    count: int
    frames: np.ndarray | None = None


class PlinkReader(DataSourceReader):
    def __init__(self, bed: str, n: int | None, missing: str, part_bytes: int):
        self.bed, self.missing, self.part_bytes = bed, missing, part_bytes
        if n is None:
            with _file(bed.removesuffix(".zst").removesuffix(".bed") + ".fam") as people:
                n = sum(1 for line in people.read().split(b"\n") if line.strip())
        self.n, self.width = n, -(-n // 4)

    def partitions(self) -> list[Sites]:
        if self.bed.endswith(".zst"):
            return self._of_frames()
        with _file(self.bed) as f:
            size, mark = f.size(), f.read(len(MAGIC))
        if mark != MAGIC:
            raise ValueError(f"{self.bed} is not a file of SNP-major genotypes")
        body = size - len(MAGIC)
        if self.width == 0 or body % self.width:
            raise _wrong_length(body, self.n)
        per = max(1, self.part_bytes // self.width)
        return [Sites(at, min(per, body // self.width - at)) for at in range(0, body // self.width, per)] or [Sites(0, 0)]

    def _of_frames(self) -> list[Sites]:
        with _file(self.bed) as f:
            table = seek_table(lambda at, n: f.read_at(n, at), f.size(), self.width)
        before = np.cumsum(table[:, 1:], 0) - table[:, 1:]
        part = np.maximum(before[:, 0] // self.part_bytes, before[:, 1] // EXPANDED_BYTES)
        cuts = np.flatnonzero(np.diff(part)) + 1
        return [Sites(int(at[0, 1]) // self.width if len(at) else 0, 0, frames) for frames, at in zip(np.split(table, cuts), np.split(before, cuts), strict=True)]

    def read(self, partition: Sites) -> Iterator[pa.RecordBatch]:
        if partition.frames is not None:
            with _file(self.bed) as f:
                yield from gathered(expanded(lambda at, n: f.read_at(n, at), partition.frames, partition.first, self.n, self.missing))
            return
        yield from gathered(self._plain(partition))

    def _plain(self, partition: Sites) -> Iterator[tuple[np.ndarray, ...]]:
        step = max(1, STEP_BYTES // self.width)
        with _file(self.bed) as f:
            for at in range(partition.first, partition.first + partition.count, step):
                some = min(step, partition.first + partition.count - at)
                f.seek(len(MAGIC) + at * self.width)
                yield from cells(f.read(some * self.width), at, self.n, self.missing)


def expanded(read_at, frames: np.ndarray, first: int, n: int, missing: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Cells of frames whose first site is `first`, one frame expanded at a time."""
    zstd = _zstd()
    for place, size, whole in frames.tolist():
        yield from cells(zstd.decompress(read_at(place, size), whole), first, n, missing)
        first += whole // -(-n // 4)


class Plink(DataSource):
    """`spark.read.format("plink").load(prefix)`: row, col, g of the cells with copies of `prefix.bed`, or of the `.bed.zst`
    that is named.

    `individuals`: their number, else the lines of `prefix.fam`; `missing`: "error" (default) or "keep" (as -1);
    `partitionBytes`: bytes for one task. A wrong mark or length is an error. Mounted folders, HDFS and the common object
    stores are read by ranges; `read_genotypes` reads a path that only Spark opens.
    """

    @classmethod
    def name(cls) -> str:
        return "plink"

    def schema(self) -> str:
        return "row long, col long, g int"

    def reader(self, schema: StructType) -> PlinkReader:
        path = self.options["path"]
        bed = path if path.endswith(".bed.zst") else path.removesuffix(".bed") + ".bed"
        n = self.options.get("individuals")
        return PlinkReader(bed, None if n is None else int(n), self.options.get("missing", "error"), int(self.options.get("partitionBytes", PART_BYTES)))


# workers may not have this package: its classes travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_genotypes(spark: SparkSession, prefix: str, n: int, missing: str = "error") -> DataFrame:
    """row, col, g of the cells with copies of `prefix.bed` with n individuals, on any path that Spark reads; where there is
    none, of `prefix.bed.zst`.

    Where tasks cannot open the path themselves, Spark hands each task the whole file, so such a file can have 2 GB.
    """
    bed = prefix.removesuffix(".bed") + ".bed"
    framed = not has_file(spark, bed) and has_file(spark, f"{bed}.zst")
    bed = f"{bed}.zst" if framed else bed
    if can_open(bed):
        spark.dataSource.register(Plink)
        return spark.read.format("plink").option("individuals", n).option("missing", missing).load(bed)
    width = -(-n // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                if framed:
                    some = lambda at, size, raw=raw: raw[at : at + size]
                    yield from gathered(expanded(some, seek_table(some, len(raw), width), 0, n, missing))
                    continue
                if raw[: len(MAGIC)] != MAGIC:
                    raise ValueError("not a file of SNP-major genotypes")
                body = memoryview(raw)[len(MAGIC) :]
                if width == 0 or len(body) % width:
                    raise _wrong_length(len(body), n)
                step = max(1, STEP_BYTES // width) * width
                yield from gathered(x for at in range(0, len(body), step) for x in cells(body[at : at + step], at // width, n, missing))

    return spark.read.format("binaryFile").load(bed).select("content").mapInArrow(run, "row long, col long, g int")


def has_file(spark: SparkSession, uri: str) -> bool:
    """Whether there is a file, asked of the store itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri if local_path(uri) is None else "file://" + os.path.abspath(local_path(uri)))
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def packed(cells: DataFrame, sites: int, n: int, compressed: bool = False) -> DataFrame:
    """Blocks of whole sites of a .bed file, from row, col, g of its cells with copies: offset, content, or else block,
    size and content of a frame.

    A task has the cells in order of their places and holds one block. A dosage that is not 0, 1, 2 or -1 (missing) is an
    error.
    """
    width = -(-n // 4)
    per = max(1, (FRAME_BYTES if compressed else STEP_BYTES) // max(1, width))
    table = np.array([CODES[copies] for copies in (-1, 0, 1, 2)], "u1")
    shape = "block long, size long, content binary" if compressed else "offset long, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, now, zstd = np.empty(per * width, "u1"), None, _zstd()

        def begin() -> None:
            raw.fill(0xFF)
            if n % 4:
                raw[width - 1 :: width] = 0xFF >> 2 * (4 - n % 4)

        def made(block: int) -> tuple:
            whole = raw[: min(per, sites - block * per) * width]
            return (block, len(content := zstd.compress(whole, asbytes=True)), content) if compressed else (len(MAGIC) + block * per * width, whole.tobytes())

        def together() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=[c.split()[0] for c in shape.split(", ")])

        held: list[tuple] = []
        for batch in batches:
            block, cell, g = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "cell", "g"))
            if ((g < -1) | (g > 2)).any():
                raise ValueError("a dosage is none of 0, 1, 2 and missing")
            cuts = np.flatnonzero(np.diff(block)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if a == z:
                    continue
                if now != block[a]:
                    if now is not None:
                        held.append(made(now))
                        if len(held) * max(1, len(held[-1][-1])) >= STEP_BYTES:
                            yield together()
                            held.clear()
                    now = int(block[a])
                    begin()
                own = cell[a:z][g[a:z] != 0]
                shift = 2 * (own & 3).astype("u1")
                np.bitwise_and.at(raw, own >> 2, ~(np.uint8(3) << shift) | table[g[a:z][g[a:z] != 0] + 1] << shift)
        if now is not None:
            held.append(made(now))
            yield together()

    block = F.floor(F.col("row") / per)
    placed = cells.select(block.alias("block"), ((F.col("row") - block * per) * (4 * width) + F.col("col")).alias("cell"), F.col("g").cast("int").alias("g"))
    # a row that changes nothing for each block, so that those without copies are there
    every = cells.sparkSession.range(-(-sites // per)).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("g"))
    return placed.unionByName(every).repartition("block").sortWithinPartitions("block", "cell").mapInArrow(run, shape)


def write_bed(cells: DataFrame, sites: int, n: int, path: str) -> None:
    """Writes row, col, g of the cells with copies as one .bed file."""
    mark = cells.sparkSession.createDataFrame([(0, MAGIC)], "offset long, content binary")
    write_bytes(packed(cells, sites, n).union(mark), path)


def write_frames(cells: DataFrame, sites: int, n: int, path: str, write) -> None:
    """Writes row, col, g of the cells with copies as one .bed.zst file; `write(df, name)` keeps the frames until their
    places are known."""
    mark = _zstd().compress(MAGIC, asbytes=True)
    width = -(-n // 4)
    per = max(1, FRAME_BYTES // max(1, width))
    frames = write(packed(cells, sites, n, True).union(cells.sparkSession.createDataFrame([(-1, len(mark), mark)], "block long, size long, content binary")), "frames")
    told = frames.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()  # two numbers
    places = running_sum(frames.select("block", "size"), [], ["block"], "size", "end")
    little = lambda column: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(column), 8, "0"), at, 2) for at in (7, 5, 3, 1)]))
    whole = F.when(F.col("block") < 0, len(MAGIC)).otherwise(F.least(F.lit(per), sites - F.col("block") * per) * width)
    entry = F.concat(little(F.col("size")), little(whole.cast("long")))
    table = places.select((F.lit(told["size"] + 8) + (F.col("block") + 1) * 8).alias("offset"), entry.alias("content"))
    ends = [(told["size"], struct.pack("<II", SKIPPABLE, 8 * told["n"] + 9)), (told["size"] + 8 + 8 * told["n"], struct.pack("<IBI", told["n"], 0, SEEKABLE))]
    rows = frames.select("block", "content").join(places, "block").select((F.col("end") - F.col("size")).alias("offset"), "content")
    write_bytes(rows.unionByName(table).union(cells.sparkSession.createDataFrame(ends, "offset long, content binary")), path)
