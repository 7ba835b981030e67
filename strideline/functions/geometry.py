"""Column expressions for planar geometry: membership, angles and headings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(dx: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dz * dz)


def distance(x: Column, z: Column, cx, cz) -> Column:
    return length(x - cx, z - cz)


def in_disc(x: Column, z: Column, cx, cz, r) -> Column:
    """Closed disc, by squares."""
    return (x - cx) * (x - cx) + (z - cz) * (z - cz) <= r * r


def in_rectangle(x: Column, z: Column, x_min, x_max, z_min, z_max) -> Column:
    """Closed axis-parallel rectangle."""
    return x.between(x_min, x_max) & z.between(z_min, z_max)


def in_tilted(x: Column, z: Column, x_min, x_max, z_min, z_max, tilt: float = 0.0, tolerance: float = 0.0) -> Column:
    """Closed rectangle turned by tilt degrees about its centre and grown by tolerance."""
    cx, cz, a = (x_min + x_max) / 2, (z_min + z_max) / 2, math.radians(-tilt)
    dx, dz = x - cx, z - cz
    u, v = dx * math.cos(a) - dz * math.sin(a) + cx, dx * math.sin(a) + dz * math.cos(a) + cz
    return in_rectangle(u, v, x_min - tolerance, x_max + tolerance, z_min - tolerance, z_max + tolerance)


def direction(dx: Column, dz: Column) -> Column:
    """Angle of a vector from the x axis, in radians."""
    return F.atan2(dz, dx)


def yaw(dx: Column, dz: Column) -> Column:
    """Heading in degrees, clockwise from the z axis."""
    return F.degrees(F.atan2(dx, dz))


def turn(a: Column, b: Column) -> Column:
    """Smallest signed difference of two angles in radians."""
    return F.atan2(F.sin(a - b), F.cos(a - b))


def wrapped(degrees: Column) -> Column:
    """Degrees in [-180, 180)."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def circular_mean(angle: Column) -> Column:
    """Aggregate: mean direction of angles in radians."""
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def number(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def seconds(text: Column) -> Column:
    """Seconds from a number, from H:M:S(.f) or from the first number in a text; null if there is none."""
    parts = F.regexp_extract(text, r"^\s*(\d+):(\d+):(\d+(?:\.\d+)?)\s*$", 1), F.regexp_extract(text, r"^\s*(\d+):(\d+):(\d+(?:\.\d+)?)\s*$", 2), F.regexp_extract(text, r"^\s*(\d+):(\d+):(\d+(?:\.\d+)?)\s*$", 3)
    h, m, s = (p.try_cast("double") for p in parts)
    first = F.regexp_extract(text, r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", 0).try_cast("double")
    return F.coalesce(text.try_cast("double"), h * 3600 + m * 60 + s, first)
