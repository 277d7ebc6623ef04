"""3x3 matrices in row-major order as lists of nine columns: registrations between images, and similarities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

M = list[Column]
LEAST_SCALE = 1e-12  # below it a projective scale or determinant counts as zero


def of(array: Column) -> M:
    """The matrix in an array column of nine values."""
    return [F.get(array, F.lit(i)) for i in range(9)]


def multiply(a: M, b: M) -> M:
    return [a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)]


def determinant(m: M) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: M) -> M:
    """The inverse, null where the determinant is as good as zero."""
    d = determinant(m)
    minor = lambda a, b, c, e: m[a] * m[e] - m[b] * m[c]
    adjugate = [minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)]
    return [F.when(F.abs(d) > LEAST_SCALE, x / d) for x in adjugate]


def transform(m: M, x: Column, y: Column, least: float = LEAST_SCALE) -> tuple[Column, Column]:
    """Where a point goes; null if it goes to infinity."""
    scale = m[6] * x + m[7] * y + m[8]
    near = F.abs(scale) > least
    return F.when(near, (m[0] * x + m[1] * y + m[2]) / scale), F.when(near, (m[3] * x + m[4] * y + m[5]) / scale)


def from_native_registration(native: M, height: Column) -> M:
    """A registration that maps target to source pixels from the bottom left, as one that maps source to target
    pixels from the top left, with a last element of 1; null where it can't be turned around."""
    one, zero, top = F.lit(1.0), F.lit(0.0), height - 1.0
    flip = [one, zero, zero, zero, -one, top, zero, zero, one]
    back = inverse(multiply(flip, multiply(native, flip)))
    return [F.when(F.abs(back[8]) > LEAST_SCALE, x / back[8]) for x in back]


def similarity_parts(m: M) -> list[Column]:
    """(x shift, y shift, angle, log scale) of the nearest similarity to a matrix's affine part; null if it has none."""
    a, b = (m[0] + m[4]) * 0.5, (m[3] - m[1]) * 0.5
    size = F.hypot(a, b)
    return [F.when(size >= 1e-6, x) for x in (m[2], m[5], F.atan2(b, a), F.log(F.greatest(size, F.lit(1e-6))))]


def similarity(x: Column, y: Column, angle: Column, log_scale: Column) -> M:
    c, s, zero = F.exp(log_scale) * F.cos(angle), F.exp(log_scale) * F.sin(angle), F.lit(0.0)
    return [c, -s, x, s, c, y, zero, zero, F.lit(1.0)]


def inverse_similarity(m: M) -> M:
    """The inverse of an affine matrix; null where its determinant is as good as zero."""
    d = m[0] * m[4] - m[1] * m[3]
    ok = F.abs(d) >= 1e-9
    made = [m[4] / d, -m[1] / d, (m[1] * m[5] - m[4] * m[2]) / d, -m[3] / d, m[0] / d, (m[3] * m[2] - m[0] * m[5]) / d]
    return [*(F.when(ok, v) for v in made), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def unwrap(angle: Column, reference: Column) -> Column:
    """The angle moved by whole turns to within half a turn of ``reference``; exactly half a turn stays on its side."""
    d = angle - reference
    turns = F.when(d > math.pi, -F.ceil((d - math.pi) / (2 * math.pi))).when(d < -math.pi, F.ceil((-d - math.pi) / (2 * math.pi))).otherwise(0)
    return angle + turns * (2 * math.pi)
