"""Quadrilaterals of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_quad(points: Column) -> Column:
    """ARRAY<STRUCT<x BIGINT, y BIGINT>> of four points given as x1, y1 ... x4, y4: in thousandths, clockwise (y grows downwards) from the point
    nearest the top left corner of their box, ties to the upper one; null unless there are eight numbers."""
    milli = F.transform(points, lambda p: F.round(p.cast("double") * 1000).cast("bigint"))
    at = lambda a, i: F.get(a, F.lit(i))
    raw = F.array(*[F.struct(at(milli, 2 * i).alias("x"), at(milli, 2 * i + 1).alias("y")) for i in range(4)])

    def order(quad: Column) -> Column:
        total = lambda part: F.aggregate(quad, F.lit(0).cast("bigint"), lambda s, p: s + p[part])
        centre_x, centre_y = total("x") / 4.0, total("y") / 4.0
        turned = F.array_sort(F.transform(quad, lambda p: F.struct(F.atan2(p["y"] - centre_y, p["x"] - centre_x).alias("angle"), p["x"].alias("x"), p["y"].alias("y"))))
        low_x, low_y = F.array_min(F.transform(quad, lambda p: p["x"])), F.array_min(F.transform(quad, lambda p: p["y"]))
        first = F.array_min(F.transform(turned, lambda p, i: F.struct(((p["x"] - low_x) + (p["y"] - low_y)).alias("far"), p["y"].alias("y"), i.alias("i"))))["i"]
        return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(turned, (i + first) % 4)["x"].alias("x"), F.get(turned, (i + first) % 4)["y"].alias("y")))

    return F.when(F.size(points) == 8, order(raw))
