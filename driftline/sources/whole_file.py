"""Data source `whole_file`: one file that tasks write together, each row's bytes at the row's own place."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from driftline.operators.ranges import running_sum


def local_path(uri: str) -> str | None:
    """The path of a file URI or plain path; None for stores that are no mounted folder."""
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme == "file" else uri if not parsed.scheme else None


@dataclass
class Written(WriterCommitMessage):
    size: int
    end: int


class WholeFileWriter(DataSourceArrowWriter):
    """Writes (offset, content) rows into a file of another name, which gets its own when all is there.

    A task that runs again writes the same bytes to the same places. The driver makes the file and tasks only open it, so
    a folder that some machine does not share is an error and not a file with holes.
    """

    def __init__(self, path: str):
        self.path, self.draft = path, f"{path}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        open(self.draft, "xb").close()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        size = end = 0
        out = os.open(self.draft, os.O_WRONLY)
        try:
            for batch in iterator:
                for offset, content in zip(batch.column("offset").to_pylist(), batch.column("content"), strict=True):
                    left = memoryview(content.as_buffer())
                    size, end, at = size + len(left), max(end, offset + len(left)), offset
                    while len(left):
                        done = os.pwrite(out, left, at)
                        left, at = left[done:], at + done
            os.fsync(out)
        finally:
            os.close(out)
        return Written(size, end)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        size, end = sum(m.size for m in told), max((m.end for m in told), default=0)
        if size != end:
            self.abort(messages)
            raise ValueError(f"{size} bytes written up to place {end} leave gaps or overlap")
        os.replace(self.draft, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)


class WholeFile(DataSource):
    """`df.write.format("whole_file").mode("overwrite").save(path)` of offset long, content binary.

    Places must fill the file from 0 without gaps. The path must be in a folder that all machines see under one name.
    """

    @classmethod
    def name(cls) -> str:
        return "whole_file"

    def schema(self) -> str:
        return "offset long, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> WholeFileWriter:
        path = local_path(self.options["path"])
        if path is None:
            raise ValueError(f"{self.options['path']} is no mounted folder: tasks cannot write at places of one file there")
        if not overwrite and os.path.exists(path):
            raise ValueError(f"{path} is there already")
        return WholeFileWriter(path)


# workers may not have this package: its classes travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_bytes(rows: DataFrame, path: str) -> None:
    """Writes rows of (offset, content) as one file."""
    rows.sparkSession.dataSource.register(WholeFile)
    rows.select(F.col("offset").cast("long").alias("offset"), "content").write.format("whole_file").mode("overwrite").save(path)


def write_lines(rows: DataFrame, order: list[str], line: Column, path: str, header: str | None = None) -> None:
    """Writes a line for each row, in order, as one text file; places are running sums of lengths by ranges of rows."""
    head = b"" if header is None else f"{header}\n".encode()
    sized = rows.select(*order, F.concat(line, F.lit("\n")).cast("binary").alias("content")).withColumn("_size", F.octet_length("content"))
    placed = running_sum(sized, [], order, "_size", "_end").select((F.col("_end") - F.col("_size") + len(head)).alias("offset"), "content")
    if head:
        placed = placed.union(rows.sparkSession.createDataFrame([(0, head)], "offset long, content binary"))
    write_bytes(placed, path)
