"""Box predicates and box arithmetic over struct<x0,y0,x1,y1> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def intersects(a: Column, b: Column) -> Column:
    """Closed boxes: touching ones intersect."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (b["x1"] <= a["x1"]) & (b["y1"] <= a["y1"])


def holds_point(a: Column, x: Column, y: Column) -> Column:
    """Closed: the border counts."""
    return (a["x0"] <= x) & (x <= a["x1"]) & (a["y0"] <= y) & (y <= a["y1"])


def holds_point_strictly(a: Column, x: Column, y: Column, tolerance: float = 0.0) -> Column:
    """Interior: points within ``tolerance`` of the border don't count."""
    return (a["x0"] + tolerance < x) & (x < a["x1"] - tolerance) & (a["y0"] + tolerance < y) & (y < a["y1"] - tolerance)


def area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def point_distance(a: Column, x: Column, y: Column) -> Column:
    """Distance of a point from a closed box, 0 inside."""
    dx = F.greatest(a["x0"] - x, F.lit(0.0), x - a["x1"])
    dy = F.greatest(a["y0"] - y, F.lit(0.0), y - a["y1"])
    return F.sqrt(dx * dx + dy * dy)


def union_of(c: str) -> Column:
    """Aggregate: the least box around the group's boxes."""
    return F.struct(F.min(f"{c}.x0").alias("x0"), F.min(f"{c}.y0").alias("y0"), F.max(f"{c}.x1").alias("x1"), F.max(f"{c}.y1").alias("y1"))


def crop(focus: Column, sheet: Column, padding: float, least_width: float = 0.0, least_height: float = 0.0) -> Column:
    """A box grown by ``padding`` of its sides, to a least share of the sheet, and cut to the sheet."""
    width = F.greatest((focus["x1"] - focus["x0"]) * (1 + 2 * padding), (sheet["x1"] - sheet["x0"]) * least_width)
    height = F.greatest((focus["y1"] - focus["y0"]) * (1 + 2 * padding), (sheet["y1"] - sheet["y0"]) * least_height)
    x, y = (focus["x0"] + focus["x1"]) / 2, (focus["y0"] + focus["y1"]) / 2
    return F.struct(F.greatest(x - width / 2, sheet["x0"]).alias("x0"), F.greatest(y - height / 2, sheet["y0"]).alias("y0"), F.least(x + width / 2, sheet["x1"]).alias("x1"), F.least(y + height / 2, sheet["y1"]).alias("y1"))


def projected(point_x: Column, point_y: Column, paper: Column, model: Column, skew: float = 1e-3) -> Column:
    """A paper point in model space, by the axis-aligned map of two boxes; null where their scales differ or a side is empty."""
    sx = F.try_divide(model["x1"] - model["x0"], paper["x1"] - paper["x0"])
    sy = F.try_divide(model["y1"] - model["y0"], paper["y1"] - paper["y0"])
    good = (sx > 0) & (sy > 0) & (F.abs(sx - sy) <= skew * F.greatest(sx, sy))
    return F.when(good, F.struct((model["x0"] + (point_x - paper["x0"]) * sx).alias("x"), (model["y0"] + (point_y - paper["y0"]) * sy).alias("y")))
