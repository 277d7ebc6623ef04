"""Rotation kernels that need linear algebra: a robust fit for each group of rays, and ordered products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import quaternion as quat
from orbweave.operators.ordered import fold, kind_of
from orbweave.operators.staging import staged

FIT = "x double, y double, z double, w double, inlier_ratio double, inlier_count long, matches long, iterations int, residual double, confidence double, fit_failure string"

# Fixed values of the robust fit: rounds, inlier bound in radians, the Gaussian factor of the median deviation, Tukey's
# constant, the least floor of the scale as a part of the bound, the least diversity and the change that ends it.
ROUNDS, INLIER, MAD_TO_SIGMA, TUKEY, FLOOR_PART, LEAST_DIVERSITY, SETTLED = 12, np.radians(3), 1.4826, 4.685, 6, 1e-4, 1e-7


def davenport(source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The unit quaternion (w not negative) that turns source rays best into target rays."""
    b = (target * weight[:, None]).T @ source
    z = np.array([b[2, 1] - b[1, 2], b[0, 2] - b[2, 0], b[1, 0] - b[0, 1]])
    k = np.zeros((4, 4))
    k[:3, :3] = b + b.T - np.trace(b) * np.eye(3)
    k[:3, 3] = k[3, :3] = z
    k[3, 3] = np.trace(b)
    q = np.linalg.eigh(k)[1][:, -1]
    return q if q[3] >= 0 else -q


def turn(q: np.ndarray, rays: np.ndarray) -> np.ndarray:
    x, y, z, w = q
    matrix = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return rays @ matrix.T


def middle(values: np.ndarray) -> float:
    ordered = np.sort(values)
    return float(ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2


def spread(rays: np.ndarray, block: int = 512) -> tuple[float, float]:
    """(sine of the angle between the two lines furthest apart, greatest angle between two rays), block by block."""
    low, line = 1.0, 1.0
    for i in range(0, len(rays), block):
        dots = rays[i : i + block] @ rays.T
        low, line = min(low, float(dots.min())), min(line, float(np.abs(dots).min()))
    return float(np.sqrt(max(0.0, 1.0 - line**2))), float(np.arccos(np.clip(low, -1, 1)))


def errors_of(q: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    a, b = turn(q, source).T, target.T
    x, y, z = a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]
    return np.arctan2(np.sqrt(x * x + y * y + z * z), a[0] * b[0] + a[1] * b[1] + a[2] * b[2])


def tukey(error: np.ndarray, threshold: float) -> np.ndarray:
    """Weights of matches by their errors: 1 at none, 0 from a bound on that follows the errors' own scale."""
    deviation = np.abs(error - middle(error))
    bound = max(threshold, TUKEY * max(MAD_TO_SIGMA * middle(deviation), threshold / FLOOR_PART))
    return np.square(np.clip(1 - np.square(error / bound), 0.0, None))


def reweighted(source: np.ndarray, target: np.ndarray, rounds: int, threshold: float) -> tuple[np.ndarray, int]:
    """(rotation, rounds taken): fits and weights in turn, until weights settle or leave fewer than two matches."""
    weights = [np.ones(len(source))]
    while True:
        q = davenport(source, target, weights[-1])
        fresh = tukey(errors_of(q, source, target), threshold)
        if (fresh > 0).sum() < 2:
            return q, len(weights)
        if np.abs(fresh - weights[-1]).max() < SETTLED:
            return davenport(source, target, fresh), len(weights)
        if len(weights) == rounds:
            return q, rounds
        weights.append(fresh)


def fit_rotation(source: np.ndarray, target: np.ndarray, rounds: int = ROUNDS, threshold: float = INLIER) -> tuple:
    """Reweighted fit with Tukey's weights (x, y, z, w, and the columns of FIT after them).

    Confidence is inlier share x angular coverage x fit quality. Fewer than two matches, or source rays along one
    line, give no rotation and a reason.
    """
    n = len(source)
    lacks = "insufficient_correspondences" if n < 2 else "insufficient_angular_diversity" if spread(source)[0] < LEAST_DIVERSITY else None
    if lacks:
        return (None, None, None, None, 0.0, 0, n, 0, float(np.pi), 0.0, lacks)
    q, taken = reweighted(source, target, rounds, threshold)
    error = errors_of(q, source, target)
    kept = np.flatnonzero(error <= threshold)
    residual = float(np.sqrt(np.mean(np.square(error[kept])))) if len(kept) else float(np.pi)
    parts = [len(kept) / n, min(1.0, spread(source[kept])[1] / (np.pi / 2)) if len(kept) > 1 else 0.0, max(0.0, 1 - residual / threshold)]
    return (*q.tolist(), parts[0], len(kept), n, taken, residual, float(np.clip(np.prod(parts), 0, 1)), None)


def fit_rotations(matches: DataFrame, *keys: str) -> DataFrame:
    """(keys and FIT) for groups of unit rays sx, sy, sz -> tx, ty, tz.

    A group is one frame pair's matches (of a view, a tile or a variant), bounded by its sampling grid; a task holds
    one group at a time, in the order of its rays, so that a fit doesn't depend on how rows came.
    """
    rays, n = ["sx", "sy", "sz", "tx", "ty", "tz"], len(keys)

    def step(held: list, row: tuple):
        held.append(row)
        return ()

    def finish(held: list):
        pairs = np.array([row[n:] for row in held], dtype=float)
        yield (*held[0][:n], *fit_rotation(pairs[:, :3], pairs[:, 3:]))

    kinds = ", ".join(f"{k} {kind_of(matches, k)}" for k in keys)
    return fold(matches.select(*keys, *rays), list(keys), rays, list, step, f"{kinds}, {FIT}", finish=finish)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([*(a[3] * b[:3] + b[3] * a[:3] + np.cross(a[:3], b[:3])), a[3] * b[3] - a[:3] @ b[:3]])


class Stretch:
    """A source's rows within one task: its number, what stands open at its end, and what it has begun and broken."""

    def __init__(self, of, number: int):
        self.of, self.number = of, number
        self.at, self.inside, self.led, self.broke, self.begun = IDENTITY, True, False, False, 0


IDENTITY = np.array([0.0, 0.0, 0.0, 1.0])
_LOCAL = "block long, local int, t double, x double, y double, z double, w double, state string, anchor boolean, led boolean, broke boolean, inside boolean"


def _local_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each stretch as if it began inside a segment (local 0) at the identity, and a closing row (order null) for each."""
    base, made, stretch, schema = TaskContext.get().partitionId() << 33, 0, None, None

    def row(s: Stretch, at, local, t, q, state, anchor, closing=False):
        return (s.of, at, s.number, local, t, *map(float, q), state, anchor, s.led, s.broke if closing else None, s.inside if closing else None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        if schema is None:
            kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), *(pa.field(n, kinds[k]) for n, k in (x.split() for x in _LOCAL.split(", ")))])
        out = []
        for of, at, start, end, state, *q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if stretch is None or of != stretch.of:
                if stretch is not None:
                    out.append(row(stretch, None, stretch.begun, None, stretch.at, None, False, closing=True))
                stretch, made = Stretch(of, base + made), made + 1
            s = stretch
            if state not in ("measured", "interpolated") or q[0] is None:
                s.inside, s.at, s.broke = False, IDENTITY, True
                continue
            if not s.broke and not s.led:
                s.led = True
                out.append(row(s, at, 0, start, IDENTITY, "segment_anchor", True))  # stays if no segment reaches into the stretch
            elif not s.inside:
                s.inside, s.begun = True, s.begun + 1
                out.append(row(s, at, s.begun, start, IDENTITY, "segment_anchor", False))
            q = np.array(q)
            new = multiply(s.at, q / np.linalg.norm(q))
            new /= np.linalg.norm(new)
            s.at = new if new @ s.at >= 0 else -new
            out.append(row(s, at, s.begun, end, s.at, state, False))
        if out:
            yield batch_of(out)
    if stretch is not None:
        yield batch_of([row(stretch, None, stretch.begun, None, stretch.at, None, False, closing=True)])


class Before:
    number, inside, at = 0, False, IDENTITY


def relative_segments(steps: DataFrame, key: str, order: str) -> DataFrame:
    """Orientations relative to where a segment of usable steps began: (key, segment, order, t, x, y, z, w, state).

    ``steps``: key, order, start, end, state, x, y, z, w. Measured and interpolated steps with a rotation are usable;
    any other ends the segment. A segment begins with an anchor (the identity, at its first step's start), and each
    step gives the product so far, in the hemisphere of the one before.

    A scan by blocks: steps are dealt by ranges of (key, order), so a long source is several tasks' work. Each task turns its
    stretches as if they began at the identity; as products are associative, a pass over one row for each stretch tells
    the orientation and the segment's number at its beginning, and its leading rows are turned by that (the hemisphere
    stays, as turning keeps the sign of neighbours' products).
    """
    kinds = f"{key} {kind_of(steps, key)}, {order} {kind_of(steps, order)}"
    dealt = steps.select(key, order, "start", "end", "state", *"xyzw").repartitionByRange(key, order).sortWithinPartitions(key, order)
    local = staged(dealt.mapInArrow(_local_segments, f"{kinds}, {_LOCAL}"), "local-segments")

    def step(b: Before, row: tuple):
        _, block, begun, x, y, z, w, led, broke, inside = row
        yield block, b.number, b.inside, *map(float, b.at)
        opened = b.number + int(led and not b.inside)
        if broke:
            b.number, b.inside = opened + begun, inside
            b.at = np.array([x, y, z, w]) if inside else IDENTITY
        else:
            b.number, b.inside, b.at = opened, True, multiply(b.at, np.array([x, y, z, w]))

    closing = local.where("state is null").select(key, "block", "local", *"xyzw", "led", "broke", "inside")
    before = fold(closing, [key], ["block"], Before, step, "block long, number int, reaches boolean, bx double, by double, bz double, bw double")
    joined = local.where("state is not null").join(before, "block").where("not (anchor and reaches)")
    segment = F.col("number") + F.when(F.col("led") & ~F.col("reaches"), 1).otherwise(0) + F.col("local")
    turned = quat.multiply([F.col(c) for c in ("bx", "by", "bz", "bw")], [F.col(c) for c in "xyzw"])
    leading = (F.col("local") == 0) & F.col("reaches")
    return joined.select(key, segment.cast("int").alias("segment"), order, "t", *[F.when(leading, t).otherwise(F.col(c)).alias(c) for t, c in zip(turned, "xyzw", strict=True)], "state")
