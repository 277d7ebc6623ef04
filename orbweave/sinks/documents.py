"""Artifacts as canonical JSON with a lineage digest, command texts and motion tables."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plain(value):
    """A row's value as JSON knows it; maps come from Arrow as lists of pairs."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("canonical JSON has no NaN or infinity")
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return {k: _plain(v) for k, v in value} if value and all(isinstance(v, tuple) for v in value) else [_plain(v) for v in value]
    return value


def canonical_json(value) -> str:
    """Sorted keys, an indent of two, no NaN, and a line break at the end."""
    return json.dumps(_plain(value), allow_nan=False, indent=2, sort_keys=True) + "\n"


def documents(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document, sha256): each row's other columns as canonical JSON, and its digest (SNK-01, SNK-09).

    Columns are the document's fields; nulls are written. Numbers that JSON can't hold are an error.
    """
    n, names = len(keys), [c for c in df.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n + i).to_pylist() for i in range(len(names))]
            made = [canonical_json(dict(zip(names, row, strict=True))) for row in zip(*columns, strict=True)]
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(made, pa.string()), pa.array(digests, pa.string())], names=[*keys, "document", "sha256"])

    rows = df.select(*keys, *names)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, document string, sha256 string")


def known_motion(sources: DataFrame, key: str, fps: float, turn_rate: float, amplitude: float, retention: float) -> DataFrame:
    """SRC-16: for each source (key, seconds) a camera that turns evenly, with a shake from frame to frame, and what a
    stabiliser leaves of it, in degrees. A source shorter than a frame has none."""
    frames = F.when(F.round(F.col("seconds") * fps) >= 1, F.sequence(F.lit(0), F.round(F.col("seconds") * fps).cast("int") - 1))
    t = F.col("_i") / fps
    shake = F.when(F.col("_i") % 2 == 0, amplitude).otherwise(-amplitude)
    rows = sources.select(key, F.explode(frames).alias("_i")).select(key, t.alias("time_seconds"), (turn_rate * t).alias("intentional_yaw_degrees"), shake.alias("injected_shake_degrees"))
    yaw, off = F.col("intentional_yaw_degrees"), F.col("injected_shake_degrees")
    return rows.withColumn("raw_yaw_degrees", yaw + off).withColumn("stabilized_yaw_degrees", yaw + retention * off)


def write_motion(df: DataFrame, path: str, order: str) -> None:
    """SNK-07: a motion table as CSV with a header, in order; refuses a folder that is there already."""
    df.orderBy(order).write.mode("errorifexists").option("header", True).csv(path)


def write_lines(lines: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """SNK-05: command lines as text in the order of ``order``; refuses a folder that is there already."""
    lines.orderBy(*order).select(line).write.mode("errorifexists").text(path)
