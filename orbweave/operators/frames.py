"""Raw frames and model outputs: differences and motion from frame to frame, and heads of detectors as boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pixels(column: pa.Array, size: int) -> np.ndarray:
    """Frames as rows of gray values; all must have ``size`` of them."""
    bodies = column.to_pylist()
    if any(len(b) != size for b in bodies):
        raise ValueError(f"a frame has {size} gray values")
    return np.frombuffer(b"".join(bodies), np.uint8).reshape(len(bodies), size).astype(np.int32)


def frame_differences(frames: DataFrame, width: int, height: int) -> DataFrame:
    """(path, record, difference): the mean absolute difference of each frame to the one before it (AGG-34).

    ``frames``: path, record, body, previous, as ``sources.records`` reads them. First frames have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now, before = (_pixels(batch.column(k), width * height) for k in (2, 3))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.abs(now - before).sum(axis=1) / (width * height), pa.float64())], names=["path", "record", "difference"])

    return frames.where("previous is not null").select("path", "record", "body", "previous").mapInArrow(run, "path string, record long, difference double")


def difference_summary(differences: DataFrame) -> DataFrame:
    """(path, frame_pair_count, mean, maximum)."""
    return differences.groupBy("path").agg(F.count(F.lit(1)).alias("frame_pair_count"), F.avg("difference").alias("mean"), F.max("difference").alias("maximum"))


def block_motion(now: np.ndarray, before: np.ndarray, radius: int, stride: int) -> tuple[int, int, float, float]:
    """(dx, dy, least difference, difference without motion) between two frames (height x width).

    Every shift up to ``radius`` is tried on every ``stride``-th pixel inside that margin. Of equal ones the shortest is
    taken, then the one that is least in |dy|, |dx|, dx and dy.
    """
    height, width = now.shape
    inner = before[radius : height - radius : stride, radius : width - radius : stride]
    tried = []
    for dy in range(-radius, radius + 1):
        rows = now[radius + dy : height - radius + dy : stride]
        for dx in range(-radius, radius + 1):
            off = int(np.abs(inner - rows[:, radius + dx : width - radius + dx : stride]).sum())
            tried.append((off, dx * dx + dy * dy, abs(dy), abs(dx), dx, dy))
    best, still = min(tried), next(t for t in tried if t[1] == 0)
    return best[4], best[5], best[0] / inner.size, still[0] / inner.size


def motion_series(frames: DataFrame, width: int, height: int, fps: float, radius: int = 8, stride: int = 2) -> DataFrame:
    """(path, record, time_seconds, dx, dy, magnitude, best, zero): how each frame's content moved since the one before (WIN-20)."""
    if width <= 2 * radius or height <= 2 * radius or stride < 1:
        raise ValueError("frames must be larger than the search, and the stride positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now, before = (_pixels(batch.column(k), width * height).reshape(-1, height, width) for k in (2, 3))
            made = [block_motion(a, b, radius, stride) for a, b in zip(now, before, strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)] if made else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["path", "record", "dx", "dy", "best", "zero"])

    found = frames.where("previous is not null").select("path", "record", "body", "previous").mapInArrow(run, "path string, record long, dx long, dy long, best double, zero double")
    return found.select("path", "record", (F.col("record") / fps).alias("time_seconds"), "dx", "dy", F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")).alias("magnitude"), "best", "zero")


# --- heads of detectors ---------------------------------------------------------------------------------------

STRIDES = (8, 16, 32)


def head_rows(size: int, strides: tuple[int, ...] = STRIDES) -> int:
    return sum((size // s) ** 2 for s in strides)


def head_violations(heads: DataFrame, key: str, head: str, size: int, classes: int, strides: tuple[int, ...] = STRIDES) -> DataFrame:
    """(rule_id, key): heads with another number of rows than the grids have cells, and rows of another length or with values that aren't finite."""
    bad_row = F.exists(head, lambda row: (F.size(row) != 5 + classes) | F.exists(row, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    rules = {"row_count": F.size(head) != head_rows(size, strides), "row_values": F.coalesce(bad_row, F.lit(True))}
    return heads.select(F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))).alias("rule_id"), key)


def decode_head(heads: DataFrame, key: str, head: str, size: int = 416, classes: int = 80, threshold: float = 0.25, strides: tuple[int, ...] = STRIDES) -> DataFrame:
    """Boxes of raw detector heads (SRC-06): (key, source_index, class, score, x, top, w, h), scaled to the image.

    A head is an array of rows (x, y, log w, log h, object, one value a class), one for each cell of the grids of all
    strides, line by line. Where a cell stands follows from its index. The class is the first of the greatest; the
    score is the object's times its. Rows below the threshold are dropped inside the array, so no value becomes a row of
    its own. Heads that break ``head_violations`` are left to it and give no boxes.
    """
    begin, cells = 0, []
    for stride in strides:
        cells.append((begin, size // stride, stride))
        begin += (size // stride) ** 2

    def at(index: Column) -> tuple[Column, Column, Column]:
        inside = lambda of: F.coalesce(*[F.when(index >= first, of(first, n, stride)) for first, n, stride in reversed(cells)])
        return inside(lambda first, n, _: (index - first) % n), inside(lambda first, n, _: F.floor((index - first) / n)), inside(lambda *cell: F.lit(cell[2]))

    def box(row: Column, index: Column) -> Column:
        scores = F.slice(row, 6, classes)
        best = F.array_max(scores)
        x, y, stride = at(index)
        unit = stride / F.lit(float(size))
        w, h = F.exp(row[2]) * unit, F.exp(row[3]) * unit
        return F.struct(
            index.cast("long").alias("source_index"), (F.array_position(scores, best) - 1).cast("long").alias("class"), (row[4] * best).alias("score"),
            ((row[0] + x) * unit - w / 2).alias("x"), ((row[1] + y) * unit - h / 2).alias("top"), w.alias("w"), h.alias("h"),
        )

    whole = (F.size(head) == head_rows(size, strides)) & F.forall(head, lambda row: (F.size(row) == 5 + classes) & F.forall(row, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    boxes = F.filter(F.transform(head, box), lambda b: b["score"] >= threshold)
    return heads.where(whole).select(key, F.inline(boxes))
