"""A source of files that are one record of fixed size after the other, such as raw gray frames.

A file is cut by offset, so that several tasks read it; a record may come with the one before it, across those
cuts too. Paths may be files or folders on any file system that Arrow can open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

READ_BYTES = 4 << 20  # read at a time


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path on it) of a URI or a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Stretch(InputPartition):
    path: str
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options["record_bytes"])
        self.each = int(options.get("records_per_task", max(1, (64 << 20) // self.size)))
        if self.size < 1 or self.each < 1:
            raise ValueError("record_bytes and records_per_task must be positive")

    def partitions(self) -> list[Stretch]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else [f for f in files.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        cut = []
        for f in sorted(found, key=lambda f: f.path):
            if f.size % self.size:
                raise ValueError(f"{f.path} ends within a record of {self.size} bytes")
            n = f.size // self.size
            cut += [Stretch(f.path, i, min(self.each, n - i)) for i in range(0, n, self.each)]
        return cut

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, size, at = opened(self.path)[0], self.size, partition.first
        few, end = max(1, READ_BYTES // size), partition.first + partition.count
        with files.open_input_file(partition.path) as f:
            before = f.read_at(size, (at - 1) * size) if at else None
            while at < end:
                n = min(few, end - at)
                raw = f.read_at(n * size, at * size)
                bodies = [raw[i * size : (i + 1) * size] for i in range(n)]
                columns = [pa.array([partition.path] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), pa.array(bodies, pa.binary()), pa.array([before, *bodies[:-1]], pa.binary())]
                yield pa.record_batch(columns, names=["path", "record", "body", "previous"])
                before, at = bodies[-1], at + n


class FixedRecords(DataSource):
    """Format ``fixed_records``: (path, record, body, previous). Options: path, record_bytes, records_per_task."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return "path string, record long, body binary, previous binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_records(spark: SparkSession, path: str, record_bytes: int, records_per_task: int | None = None) -> DataFrame:
    """(path, record, body, previous) of every record; a file that ends within a record is an error, an empty one has none."""
    spark.dataSource.register(FixedRecords)
    reader = spark.read.format("fixed_records").option("record_bytes", record_bytes)
    if records_per_task:
        reader = reader.option("records_per_task", records_per_task)
    return reader.load(path)
