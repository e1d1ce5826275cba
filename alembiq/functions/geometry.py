"""Distances, angles and boxes over coordinate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

Point = tuple[Column, Column, Column]


def point(prefix: str = "") -> Point:
    return tuple(F.col(f"{prefix}{c}").cast("double") for c in "xyz")


def _minus(a: Point, b: Point) -> Point:
    return tuple(p - q for p, q in zip(a, b))


def _dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Point, b: Point) -> Point:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def distance(a: Point, b: Point) -> Column:
    d = _minus(a, b)
    return F.sqrt(_dot(d, d))


def angle(a: Point, b: Point, c: Point) -> Column:
    """Degrees at ``b``; null where two points coincide."""
    u, v = _minus(a, b), _minus(c, b)
    n = F.sqrt(_dot(u, u)) * F.sqrt(_dot(v, v))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(u, v) / F.when(n > 0, n)))))


def dihedral(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Degrees from -180 to 180 about the axis from ``b`` to ``c``."""
    b0, b1, b2 = _minus(b, a), _minus(c, b), _minus(d, c)
    n0, n1 = _cross(b0, b1), _cross(b1, b2)
    return F.degrees(F.atan2(F.sqrt(_dot(b1, b1)) * _dot(b0, n1), _dot(n0, n1)))


def box(padding: float = K.BOX_PADDING) -> list[Column]:
    """Aggregates of a docking box: the centre of the coordinates, and their extent with padding on both sides."""
    centre = [((F.min(c) + F.max(c)) / 2).alias(f"center_{c}") for c in "xyz"]
    return centre + [(F.max(c) - F.min(c) + 2 * padding).alias(f"size_{c}") for c in "xyz"]


def valid_box() -> Column:
    lo, hi = K.BOX_SIDES
    return F.col("size_x").between(lo, hi) & F.col("size_y").between(lo, hi) & F.col("size_z").between(lo, hi)


def box_volume() -> Column:
    return F.col("size_x") * F.col("size_y") * F.col("size_z")
