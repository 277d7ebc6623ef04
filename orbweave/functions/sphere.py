"""Angles, rays and pixels of an equirectangular sphere, as column expressions.

Yaw is in [-pi, pi) with +Z ahead and +X to the right, +Y up; everything is in radians unless named otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = 2 * math.pi


def wrap_yaw(yaw: Column) -> Column:
    return F.pmod(yaw + math.pi, F.lit(TURN)) - math.pi


def wrap_floor(yaw: Column) -> Column:
    """``wrap_yaw`` in the arithmetic of SQL without a positive modulus, to the last bit; by rounding it may leave the range by one bit."""
    return yaw + math.pi - TURN * F.floor((yaw + math.pi) / TURN) - math.pi


def unwrap_yaw(yaw: Column, reference: Column) -> Column:
    """The angle equal to ``yaw`` that is nearest to ``reference``."""
    return reference + wrap_yaw(yaw - reference)


def circular_degrees(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def pixel_to_angles(x: Column, y: Column, width: float, height: float) -> tuple[Column, Column]:
    """(yaw, pitch) of a pixel's centre."""
    return wrap_yaw((x + 0.5) / width * TURN - math.pi), math.pi / 2 - (y + 0.5) / height * math.pi


def angles_to_pixel(yaw: Column, pitch: Column, width: float, height: float) -> tuple[Column, Column]:
    bounded = F.greatest(F.least(pitch, F.lit(math.pi / 2)), F.lit(-math.pi / 2))
    return (wrap_yaw(yaw) + math.pi) / TURN * width - 0.5, (math.pi / 2 - bounded) / math.pi * height - 0.5


def direction(yaw: Column, pitch: Column) -> tuple[Column, Column, Column]:
    return F.cos(pitch) * F.sin(yaw), F.sin(pitch), F.cos(pitch) * F.cos(yaw)


def ray_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.atan2(x, z), F.asin(F.greatest(F.least(y, F.lit(1.0)), F.lit(-1.0)))


def distance(yaw_a: Column, pitch_a: Column, yaw_b: Column, pitch_b: Column) -> Column:
    """Great-circle distance in the form that stays exact for near and for opposite directions."""
    return ray_distance(direction(yaw_a, pitch_a), direction(yaw_b, pitch_b))


def ray_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """The same of two unit rays."""
    return F.atan2(*across_along(a, b))


# The JVM's sine, cosine and arctangent differ from the C library's in the last bit. Where a distance is compared with a limit on
# the same grid of degrees, that bit decides; so rays, and distances at a limit's very edge, are taken from the C library.
EDGE = 1e-12


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in "xyz"]))
def exact_direction(yaw: pa.Array, pitch: pa.Array) -> pa.Array:
    """``direction`` by the C library, once a row."""
    sin, cos = math.sin, math.cos
    rows = [None if y is None or p is None else (cos(p) * sin(y), sin(p), cos(p) * cos(y)) for y, p in zip(yaw.to_pylist(), pitch.to_pylist(), strict=True)]
    columns = [pa.array([r and r[k] for r in rows], pa.float64()) for k in range(3)]
    return pa.StructArray.from_arrays(columns, ["x", "y", "z"])


@F.arrow_udf(T.BooleanType())
def _edge_within(across: pa.Array, along: pa.Array, limit: pa.Array) -> pa.Array:
    """Whether the angle is at most the limit; true where there is none to look at."""
    there = np.asarray(limit.is_valid())
    made = np.ones(len(limit), dtype=bool)
    for i in np.flatnonzero(there).tolist():
        made[i] = math.atan2(across[i].as_py(), along[i].as_py()) <= limit[i].as_py()
    return pa.array(made)


@F.arrow_udf(T.ArrayType(T.LongType()))
def edge_ids(edges: pa.Array) -> pa.Array:
    """Ids of (id, across, along, limit) whose angle is at most the limit."""
    return pa.array([[e["id"] for e in row or () if math.atan2(e["across"], e["along"]) <= e["limit"]] for row in edges.to_pylist()], pa.list_(pa.int64()))


def across_along(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Sine and cosine of the angle between two unit rays."""
    (ax, ay, az), (bx, by, bz) = a, b
    cx, cy, cz = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    return F.sqrt(cx * cx + cy * cy + cz * cz), ax * bx + ay * by + az * bz


def edge_within(pairs: DataFrame, far: str, limit: str, across: str, along: str) -> DataFrame:
    """``pairs``, of which ``far`` is at most ``limit`` and ``EDGE``, without those beyond ``limit``."""
    at_edge = F.abs(F.col(far) - F.col(limit)) <= EDGE
    return pairs.where(_edge_within(*[F.when(at_edge, F.col(c)) for c in (across, along, limit)]))


def forward_distance(yaw: Column, pitch: Column) -> Column:
    return F.acos(F.greatest(F.least(F.cos(pitch) * F.cos(yaw), F.lit(1.0)), F.lit(-1.0)))


def viewport_ray(x: Column, y: Column, yaw: Column, pitch: Column, h_fov: Column, aspect: float | Column, roll: Column | None = None) -> tuple[Column, Column, Column]:
    """World ray of a normalised top-left viewport point: roll about the view axis, then pitch, then yaw."""
    half = F.tan(h_fov / 2)
    u, v = (2 * x - 1) * half, (1 - 2 * y) * half / aspect
    n = F.sqrt(u * u + v * v + 1)
    dx, dy, dz = u / n, v / n, 1 / n
    if roll is not None:
        dx, dy = dx * F.cos(roll) - dy * F.sin(roll), dx * F.sin(roll) + dy * F.cos(roll)
    ry, rz = dy * F.cos(pitch) + dz * F.sin(pitch), dz * F.cos(pitch) - dy * F.sin(pitch)
    return dx * F.cos(yaw) + rz * F.sin(yaw), ry, rz * F.cos(yaw) - dx * F.sin(yaw)


def pixel_ray(px: Column, py: Column, width: Column | float, height: Column | float, yaw: Column, pitch: Column, h_fov: Column, roll: Column | None = None) -> tuple[Column, Column, Column]:
    """World ray through a viewport pixel's centre; null outside the viewport."""
    ray = viewport_ray((px + 0.5) / width, (py + 0.5) / height, yaw, pitch, h_fov, width / height, roll)
    return tuple(F.when(inside_viewport(px, py, width, height), k) for k in ray)


def inside_viewport(px: Column, py: Column, width: Column | float, height: Column | float) -> Column:
    """Whether a pixel coordinate lies on the image, its edges included."""
    return F.coalesce((px >= -0.5) & (px <= width - 0.5) & (py >= -0.5) & (py <= height - 0.5), F.lit(False))


def box_centre_angles(box: list[Column], yaw: Column, pitch: Column, h_fov: Column, aspect: float) -> tuple[Column, Column]:
    """(yaw, pitch) of the middle of a box (x, y, width, height from the bottom left), by one arctangent an axis."""
    half = F.tan(h_fov / 2)
    mx, my = box[0] + box[2] / 2, box[1] + box[3] / 2
    up = pitch + F.atan((2 * my - 1) * half / aspect)
    return wrap_yaw(yaw + F.atan((2 * mx - 1) * half)), F.greatest(-F.pi() / 2, F.least(F.pi() / 2, up))


def box_extent(width: Column, h_fov: Column) -> Column:
    """The horizontal extent of a box of a viewport, at least 0.01 and just under half a turn."""
    return F.least(F.lit(math.pi - 0.001), F.greatest(F.lit(0.01), 2 * F.atan(width * F.tan(h_fov / 2))))


def seed_box(x: Column, top: Column, width: Column, height: Column, view_width: float, view_height: float, tolerance: float = 0.0) -> dict[str, Column]:
    """A top-left box as one from the bottom left, cut to the viewport where it stands out by ``tolerance`` pixels at most.

    All parts are null for a box that has no size, begins outside, or stands out further.
    """
    right, lower = x + width, top + height
    ok = (width > 0) & (height > 0) & (x >= 0) & (top >= 0) & (right <= 1 + tolerance / view_width) & (lower <= 1 + tolerance / view_height)
    made = {"x": x, "y": F.when(lower > 1, 0.0).otherwise(1.0 - top - height), "width": F.when(right > 1, 1.0 - x).otherwise(width), "height": F.when(lower > 1, 1.0 - top).otherwise(height)}
    return {k: F.when(ok, v) for k, v in made.items()}


def smoothstep(s: Column) -> Column:
    t = F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0))
    return t * t * t * (t * (t * 6 - 15) + 10)


def segment_limits(change: Column, seconds: Column) -> tuple[Column, Column, Column]:
    """Greatest speed, acceleration and jerk of a quintic move."""
    size = F.abs(change)
    return size * (15 / 8) / seconds, size * (10 * math.sqrt(3) / 3) / (seconds * seconds), size * 60 / (seconds * seconds * seconds)


def box_iou(a: list[Column], b: list[Column], empty: float) -> Column:
    """Of boxes (left, top, width, height); ``empty`` where the union has no area."""
    wide = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - wide * high
    return F.when(union > 0, wide * high / union).otherwise(F.lit(empty))
