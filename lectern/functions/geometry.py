"""Boxes are structs (l, t, r, b) of doubles; every function here is a Column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(l: Column, t: Column, r: Column, b: Column) -> Column:  # noqa: E741
    return F.struct(l.cast("double").alias("l"), t.cast("double").alias("t"), r.cast("double").alias("r"), b.cast("double").alias("b"))


def valid(x: Column) -> Column:
    """Inside the unit square, left of right and above of below; false for null."""
    inside = (x["l"] >= 0) & (x["t"] >= 0) & (x["r"] <= 1) & (x["b"] <= 1)
    return F.coalesce(inside & (x["l"] < x["r"]) & (x["t"] < x["b"]), F.lit(False))


def area(x: Column) -> Column:
    return F.greatest(F.lit(0.0), (x["r"] - x["l"]) * (x["b"] - x["t"]))


def intersection(x: Column, y: Column) -> Column:
    w = F.least(x["r"], y["r"]) - F.greatest(x["l"], y["l"])
    h = F.least(x["b"], y["b"]) - F.greatest(x["t"], y["t"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(x: Column, y: Column) -> Column:
    both = intersection(x, y)
    union = area(x) + area(y) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def coverage(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that lies in ``outer``; 0 for an empty box."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def centre_x(x: Column) -> Column:
    return (x["l"] + x["r"]) / 2


def centre_y(x: Column) -> Column:
    return (x["t"] + x["b"]) / 2


def centre_inside(inner: Column, outer: Column) -> Column:
    cx, cy = centre_x(inner), centre_y(inner)
    return (cx >= outer["l"]) & (cx <= outer["r"]) & (cy >= outer["t"]) & (cy <= outer["b"])


def x_overlap(x: Column, y: Column) -> Column:
    """Shared width over the width of the narrower box."""
    narrow = F.least(x["r"] - x["l"], y["r"] - y["l"])
    return F.when(narrow > 0, F.greatest(F.lit(0.0), F.least(x["r"], y["r"]) - F.greatest(x["l"], y["l"])) / narrow).otherwise(0.0)


def y_overlap(x: Column, y: Column) -> Column:
    low = F.least(x["b"] - x["t"], y["b"] - y["t"])
    return F.when(low > 0, F.greatest(F.lit(0.0), F.least(x["b"], y["b"]) - F.greatest(x["t"], y["t"])) / low).otherwise(0.0)


def gap(x: Column, y: Column) -> Column:
    """Distance of two boxes, 0 if they touch."""
    dx = F.greatest(F.lit(0.0), y["l"] - x["r"], x["l"] - y["r"])
    dy = F.greatest(F.lit(0.0), y["t"] - x["b"], x["t"] - y["b"])
    return F.hypot(dx, dy)


def pad(x: Column, by: float = 0.02) -> Column:
    return box(F.greatest(F.lit(0.0), x["l"] - by), F.greatest(F.lit(0.0), x["t"] - by), F.least(F.lit(1.0), x["r"] + by), F.least(F.lit(1.0), x["b"] + by))


def union_of(column: str) -> Column:
    """Aggregate: the smallest box around all; null if there is none."""
    f = lambda fn, k: fn(F.col(f"{column}.{k}"))
    around = box(f(F.min, "l"), f(F.min, "t"), f(F.max, "r"), f(F.max, "b"))
    return F.when(F.count(F.col(column)) > 0, around)


def raw_box(x: Column) -> Column:
    """The box of an array of 4 numbers (l, t, r, b) or of 8 (four points); null for any other or with a null in it."""
    at = lambda k: F.get(x, F.lit(k))
    axis = lambda k: [at(i) for i in range(k, 8, 2)]
    full = lambda n: reduce(Column.__and__, (at(i).isNotNull() for i in range(n)), F.size(x) == n)
    eight = box(F.least(*axis(0)), F.least(*axis(1)), F.greatest(*axis(0)), F.greatest(*axis(1)))
    return F.when(full(4), box(*map(at, range(4)))).when(full(8), eight)
