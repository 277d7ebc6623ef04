"""Sinks whose output appears as a whole or not at all, and never in place of something.

Tasks write parts into a folder beside the target whose name begins with a dot, each attempt under a name of its own. The
commit takes the parts of the attempts that Spark reports, and makes the target visible by one link or
rename, which fails if the target is there by then. An abort, and a commit that fails, removes the folder.

* ``atomic_file``: one file of all rows in order (a column of strings, written as lines, or of bytes). For documents and
  tables of a size that one process can join by streaming.
* ``atomic_bundle``: a folder of files, one for each row (name, content), and a manifest of their sizes and digests. Contents
  stay where tasks wrote them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

MANIFEST = "artifacts.json"
_NAME = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9._-]*")


def local_path(path: str) -> str:
    """The path of a mounted folder; links and renames that refuse to overwrite are POSIX's."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"atomic sinks write to mounted folders, not to {parts.scheme}://")
    return unquote(parts.path)


@dataclass
class Parts(WriterCommitMessage):
    partition: int
    files: list  # (name in the folder, name in the target, bytes, SHA-256)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("atomic sinks never overwrite: use mode('append') with a path that isn't there")
        self.target = local_path(options["path"].rstrip("/"))
        self.refuse()
        self.folder = os.path.join(os.path.dirname(self.target), f".{os.path.basename(self.target)}.{uuid.uuid4().hex}")
        self.lines = isinstance(schema[-1].dataType, StringType)
        self.check(schema)

    def refuse(self) -> None:
        if os.path.lexists(self.target):
            raise FileExistsError(self.target)

    def put(self, name: str, chunks: Iterator[bytes]) -> tuple:
        os.makedirs(self.folder, exist_ok=True)
        own, digest, size = f"{name}-{uuid.uuid4().hex}", hashlib.sha256(), 0
        with open(os.path.join(self.folder, own), "wb") as f:
            for chunk in chunks:
                f.write(chunk)
                digest.update(chunk)
                size += len(chunk)
            f.flush()
            os.fsync(f.fileno())
        return own, name, size, digest.hexdigest()

    def commit(self, messages: list) -> None:
        try:
            os.makedirs(self.folder, exist_ok=True)
            self.show(sorted((m for m in messages if m is not None), key=lambda m: m.partition))
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class _FileWriter(_Writer):
    def check(self, schema: StructType) -> None:
        if len(schema) != 1 or not isinstance(schema[0].dataType, (StringType, BinaryType)):
            raise ValueError("atomic_file takes one column, of strings or of bytes")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        def chunks():
            for batch in iterator:
                for value in batch.column(0).to_pylist():
                    if value is None:
                        raise ValueError("a null is no line")
                    yield value.encode() + b"\n" if self.lines else value

        return Parts(TaskContext.get().partitionId(), [self.put("part", chunks())])

    def show(self, messages: list) -> None:
        whole = os.path.join(self.folder, "whole")
        with open(whole, "wb") as out:
            for m in messages:
                for own, *_ in m.files:
                    with open(os.path.join(self.folder, own), "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 20)
            out.flush()
            os.fsync(out.fileno())
        os.link(whole, self.target)  # fails if the target is there


class _BundleWriter(_Writer):
    def check(self, schema: StructType) -> None:
        if schema.names != ["name", "content"] or not isinstance(schema[1].dataType, (StringType, BinaryType)):
            raise ValueError("atomic_bundle takes the columns name and content")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        files = []
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name is None or content is None or not _NAME.fullmatch(name) or name == MANIFEST:
                    raise ValueError(f"no file of a bundle: {name!r}")
                files.append(self.put(name, iter([content.encode() if self.lines else content])))
        return Parts(TaskContext.get().partitionId(), files)

    def show(self, messages: list) -> None:
        files = sorted((f for m in messages for f in m.files), key=lambda f: f[1])
        names = [f[1] for f in files]
        if len(set(names)) < len(names):
            raise ValueError(f"a bundle holds a name once: {sorted({n for n in names if names.count(n) > 1})}")
        whole = os.path.join(self.folder, f"bundle-{uuid.uuid4().hex}")
        os.mkdir(whole)
        for own, name, *_ in files:
            os.rename(os.path.join(self.folder, own), os.path.join(whole, name))
        with open(os.path.join(whole, MANIFEST), "w") as f:
            f.write(json.dumps({name: {"bytes": size, "sha256": digest} for _, name, size, digest in files}, indent=2, sort_keys=True) + "\n")
            f.flush()
            os.fsync(f.fileno())
        self.refuse()
        os.rename(whole, self.target)  # fails if a folder with files is there


class AtomicFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "atomic_file"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _FileWriter(self.options, schema, overwrite)


class AtomicBundle(DataSource):
    @classmethod
    def name(cls) -> str:
        return "atomic_bundle"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _BundleWriter(self.options, schema, overwrite)


def write_file(rows: DataFrame, path: str) -> None:
    """SNK-02: one file of a column of lines or bytes, in the rows' order (sort before); refuses a path that is there."""
    rows.sparkSession.dataSource.register(AtomicFile)
    rows.write.format("atomic_file").mode("append").save(path)


def write_bundle(files: DataFrame, path: str) -> None:
    """SNK-03: a folder of files (name, content) that appears at once, with a manifest; refuses a path that is there."""
    files.sparkSession.dataSource.register(AtomicBundle)
    files.select("name", "content").write.format("atomic_bundle").mode("append").save(path)
