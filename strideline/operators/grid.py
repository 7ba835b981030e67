"""Which of many discs and zones hold a point: an equality join on the point's cell of a grid over the plane.

Every shape goes to the cells that its bounding box overlaps, and a cell keeps its shapes in one row, in their order. So a
point meets one row, and only the shapes of its own cell are tested; points are neither multiplied nor moved to be
grouped again. Cells are as wide as the middle one of the shapes, or wider where a few large shapes would otherwise
fill too many.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.plans.params import Junction, Zone

#: Cells that a shape takes on the average, at most.
CELLS_PER_SHAPE = 64
#: Shapes whose cells (some 100 bytes each) may be broadcast; those of more are left to Spark's choice.
MOST_BROADCAST = 10_000
#: A shape: its place in the list, name, and either a disc or a rectangle turned about (cx, cz); then its bounding box.
_SHAPE = "place int, junction int, name string, cx double, cz double, r double, u0 double, u1 double, v0 double, v1 double, cos double, sin double, x0 double, x1 double, z0 double, z1 double"


def disc(place: int, junction: int | None, name: str | None, cx: float, cz: float, r: float) -> tuple:
    cx, cz, r = float(cx), float(cz), float(r)
    return (place, junction, name, cx, cz, r, None, None, None, None, None, None, cx - r, cx + r, cz - r, cz + r)


def of_junctions(at: Sequence[Junction], radius: str = "reach") -> list[tuple]:
    return [disc(k, j.junction, None, j.cx, j.cz, getattr(j, radius)) for k, j in enumerate(at)]


def of_zones(zones: Sequence[Zone]) -> list[tuple]:
    """Zones as shapes; one that is neither circle nor rectangle holds nothing."""
    out = []
    for k, zone in enumerate(zones):
        if zone.circle:
            cx, cz, r = zone.circle
            out.append(disc(k, None, zone.name, cx, cz, r + zone.tolerance))
        elif zone.rectangle:
            x0, x1, z0, z1 = map(float, zone.rectangle)
            cx, cz, a = (x0 + x1) / 2, (z0 + z1) / 2, math.radians(-zone.tilt)
            hx, hz = (x1 - x0) / 2 + zone.tolerance, (z1 - z0) / 2 + zone.tolerance
            if hx >= 0 and hz >= 0:
                wide, deep = (abs(hx * math.cos(a)) + abs(hz * math.sin(a)), abs(hx * math.sin(a)) + abs(hz * math.cos(a)))
                slack = 1e-9 * (1 + abs(cx) + abs(cz) + wide + deep)  # turning rounds
                out.append((k, None, zone.name, cx, cz, None, x0 - zone.tolerance, x1 + zone.tolerance, z0 - zone.tolerance, z1 + zone.tolerance, math.cos(a), math.sin(a), cx - wide - slack, cx + wide + slack, cz - deep - slack, cz + deep + slack))
    return out


def _width(shapes: Sequence[tuple]) -> float:
    sides = sorted(max(s[-3] - s[-4], s[-1] - s[-2]) for s in shapes)
    width = sides[len(sides) // 2] or max(sides[-1], 1.0)
    while sum((side // width + 2) ** 2 for side in sides) > CELLS_PER_SHAPE * len(sides):
        width *= 2
    return width


def _holds(s: Column, zones: Sequence[Zone] | None) -> Column:
    """Whether a shape holds the point (x, z), by the definitions of geometry.in_disc() and in_tilted(), or for junctions by the distance."""
    dx, dz = F.col("x") - s["cx"], F.col("z") - s["cz"]
    if zones is None:
        return F.sqrt(dx * dx + dz * dz) <= s["r"]
    u, v = dx * s["cos"] - dz * s["sin"] + s["cx"], dx * s["sin"] + dz * s["cos"] + s["cz"]
    return F.when(s["r"].isNotNull(), dx * dx + dz * dz <= s["r"] * s["r"]).otherwise(u.between(s["u0"], s["u1"]) & v.between(s["v0"], s["v1"]))


def _cells(spark: SparkSession, shapes: Sequence[tuple], width: float, as_: str) -> DataFrame:
    """_gx, _gz and the cell's shapes in their order."""
    table = spark.createDataFrame(shapes, _SHAPE)
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}0") / width), F.floor(F.col(f"{c}1") / width)))
    spread = table.withColumn("_gx", span("x")).withColumn("_gz", span("z"))
    found = spread.groupBy("_gx", "_gz").agg(F.sort_array(F.collect_list(F.struct("place", "junction", "name", "cx", "cz", "r", "u0", "u1", "v0", "v1", "cos", "sin"))).alias(as_))
    return F.broadcast(found) if len(shapes) <= MOST_BROADCAST else found


def holding(points: DataFrame, shapes: Sequence[tuple], zones: Sequence[Zone] | None = None, as_: str = "_held") -> DataFrame:
    """points with an array of the shapes that hold each, in their order (place, junction, name, cx, cz, r, ...), null or empty for none. A point without coordinates is in none."""
    if not shapes:
        return points.withColumn(as_, F.lit(None).cast("array<struct<place:int,junction:int,name:string>>"))
    width = _width(shapes)
    keyed = points.withColumns({"_gx": F.floor(F.col("x") / width), "_gz": F.floor(F.col("z") / width)})
    joined = keyed.join(_cells(points.sparkSession, shapes, width, as_), ["_gx", "_gz"], "left")
    return joined.withColumn(as_, F.filter(as_, lambda s: _holds(s, zones))).drop("_gx", "_gz")


def near(points: DataFrame, discs: Sequence[tuple]) -> DataFrame:
    """points beside each disc that holds them: junction, cx, cz, radius (the disc's) and dist more."""
    found = holding(points, discs).withColumn("_s", F.explode("_held"))
    dx, dz = F.col("x") - F.col("_s.cx"), F.col("z") - F.col("_s.cz")
    return found.select(*points.columns, *[F.col(f"_s.{c}").alias(n) for c, n in (("junction", "junction"), ("cx", "cx"), ("cz", "cz"), ("r", "radius"))], F.sqrt(dx * dx + dz * dz).alias("dist"))
