"""Sphere coordinates: uv in [0, 1] (left/bottom to right/top), unit xyz, pixels.

A 3-vector is a plain tuple of three columns, so every expression flattens into
one projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_up

Vec3 = tuple[Column, Column, Column]


def uv_to_xyz(u: Column, v: Column) -> Vec3:
    """Point on the unit sphere. A negative u (repeated map) is shifted by one, once."""
    theta = F.when(u < 0, u + 1).otherwise(u) * (2.0 * math.pi)
    phi = (v - 0.5) * math.pi
    ring = F.cos(phi)
    return normalise((-ring * F.sin(theta), F.sin(phi), -ring * F.cos(theta)))


def xyz_to_uv(p: Vec3) -> tuple[Column, Column]:
    """Longitude and latitude as uv; |y| > 1 gives NaN.

    Spark's atan2 reads -0.0 as 0.0, so a point on the seam has u = 1, never 0.
    """
    x, y, z = p
    return (
        F.atan2(x, z) / (2.0 * math.pi) + 0.5,
        F.asin(y) / math.pi + 0.5,
    )


def uv_to_pixel(u: Column, v: Column, height: int) -> tuple[Column, Column]:
    return half_up(u * float(2 * height)), half_up((F.lit(1.0) - v) * float(height))


def pixel_to_uv(px: Column, py: Column, height: int) -> tuple[Column, Column]:
    return px / float(2 * height), F.lit(1.0) - py / float(height)


def vec(prefix: str) -> Vec3:
    """Columns ``<prefix>x, <prefix>y, <prefix>z``."""
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def dot(a: Vec3, b: Vec3) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec3, b: Vec3) -> Vec3:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def sub(a: Vec3, b: Vec3) -> Vec3:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def length(a: Vec3) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Vec3) -> Vec3:
    n = length(a)
    return tuple(F.try_divide(c, n) for c in a)


def lerp(start: Column, end: Column, fraction: Column) -> Column:
    """(1 - t) * start + t * end."""
    return start * (F.lit(1.0) - fraction) + end * fraction


def great_circle_angle(a: Vec3, b: Vec3) -> Column:
    return F.acos(dot(a, b))


def chord_half_angle(d: Column) -> Column:
    return F.asin(d / 2.0)


def angle(a: Vec3, b: Vec3, c: Vec3) -> Column:
    """Spherical angle at b; NULL for a degenerate corner.

    A cosine that rounding pushed past 1 counts as 1, so a flat angle is 0 and not NaN.
    """
    ab, cb = cross(a, b), cross(c, b)
    cosine = F.try_divide(dot(ab, cb), length(ab) * length(cb))
    return F.acos(F.when(cosine > 1, F.lit(1.0)).when(cosine < -1, F.lit(-1.0)).otherwise(cosine))


def triangle_angles(a: Vec3, b: Vec3, c: Vec3) -> list[Column]:
    return [angle(a, b, c), angle(b, a, c), angle(b, c, a)]


def triangle_area(a: Vec3, b: Vec3, c: Vec3) -> Column:
    """Spherical excess."""
    at_b, at_a, at_c = triangle_angles(a, b, c)
    return at_b + at_a + at_c - math.pi


def quad_angles(a: Vec3, b: Vec3, c: Vec3, d: Vec3) -> list[Column]:
    return [angle(b, a, c), angle(a, b, d), angle(a, c, d), angle(b, d, c)]


def quad_area(a: Vec3, b: Vec3, c: Vec3, d: Vec3) -> Column:
    return triangle_area(a, c, b) + triangle_area(b, c, d)
