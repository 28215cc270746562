"""Box algebra on corner structs ``struct<x1,y1,x2,y2>`` of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TRACK_IOU = 0.1  # fixed value of the association policy
BOX_TYPE = "struct<x1:double,y1:double,x2:double,y2:double>"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corner box from four numbers."""
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).cast(BOX_TYPE)


def box_from_size(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Corner box from origin and size; null unless both sizes are positive."""
    return F.when((width > 0) & (height > 0), box(x, y, x + width, y + height))


def polygon_to_box(points: Column) -> Column:
    """Bounding corner box of ``array<array<double>>``; null for empty or malformed polygons."""
    valid = (F.size(points) > 0) & F.forall(points, lambda p: F.size(p) == 2)
    xs = F.transform(points, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.when(
        valid, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    )


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def intersection(left: Column, right: Column) -> Column:
    """Overlap area, zero for disjoint boxes."""
    across = F.least(left["x2"], right["x2"]) - F.greatest(left["x1"], right["x1"])
    down = F.least(left["y2"], right["y2"]) - F.greatest(left["y1"], right["y1"])
    return F.greatest(across, F.lit(0.0)) * F.greatest(down, F.lit(0.0))


def iou(left: Column, right: Column) -> Column:
    """Intersection over union; zero where the union is empty."""
    shared = intersection(left, right)
    union = area(left) + area(right) - shared
    return F.when(union != 0, shared / F.nullif(union, F.lit(0.0))).otherwise(F.lit(0.0))


def spatially_compatible(left: Column, right: Column) -> Column:
    """Overlap of at least a tenth, or centres no further apart than the largest side."""
    shared = intersection(left, right)
    one = F.lit(1.0)
    union = F.greatest(one, area(left)) + F.greatest(one, area(right)) - shared
    scale = F.greatest(width(left), height(left), width(right), height(right), one)
    dx = F.abs((left["x1"] + left["x2"]) / 2 - (right["x1"] + right["x2"]) / 2)
    dy = F.abs((left["y1"] + left["y2"]) / 2 - (right["y1"] + right["y2"]) / 2)
    return (shared / union >= MIN_TRACK_IOU) | ((dx <= scale) & (dy <= scale))
