"""The four corners of a label in a frame: their order, a margin around them, and the size of the crop.

A contour is an array of points (x, y).  Everything is arithmetic over the array
inside its row; cutting the image out is left to the caller's image library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.functions.text import let

# How far corners move away from their centre, and the shortest side of a crop in pixels.
MARGIN, LEAST_SIDE = 1.03, 20
POINT = "struct<x:double,y:double>"


def ordered(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left; null unless there are four points that are four different corners.

    The first has the least sum of its coordinates, the second the least difference y - x,
    the third the greatest sum and the fourth the greatest difference; of equal points the first counts.
    """
    numbered = F.transform(points, lambda p, i: F.struct((p["x"] + p["y"]).alias("sum"), (p["y"] - p["x"]).alias("gap"), i.alias("i")))

    def chosen(p: Column) -> Column:
        least = lambda c: F.array_min(F.transform(p, lambda q: F.struct(q[c].alias("v"), q["i"].alias("i"))))["i"]
        most = lambda c: -F.array_max(F.transform(p, lambda q: F.struct(q[c].alias("v"), (-q["i"]).alias("i"))))["i"]
        return F.array(least("sum"), least("gap"), most("sum"), most("gap"))

    corners = let(numbered, chosen)
    fit = lambda c: F.when(F.size(F.array_distinct(c)) == 4, F.transform(c, lambda i: F.get(points, i)))
    return F.when(F.size(points) == 4, let(corners, fit))


def spread(corners: Column, width: Column, height: Column, margin: float = MARGIN) -> Column:
    """The corners moved away from their centre by the margin, within a frame of the given size."""
    mean = lambda c: F.aggregate(corners, F.lit(0.0), lambda a, p: a + p[c]) / 4

    def moved(centre: Column) -> Column:
        one = lambda p, c, most: F.least(F.greatest(centre[c] + (p[c] - centre[c]) * margin, F.lit(0.0)), (most - 1).cast("double"))
        return F.transform(corners, lambda p: F.struct(one(p, "x", width).alias("x"), one(p, "y", height).alias("y")))

    return let(F.struct(mean("x").alias("x"), mean("y").alias("y")), moved)


def crop_size(corners: Column) -> Column:
    """(width, height) of the upright crop: the longer of each two opposite sides, rounded half to even; null if it is too small to cut."""

    def side(p: Column, a: int, b: int) -> Column:
        return F.sqrt(F.pow(F.get(p, a)["x"] - F.get(p, b)["x"], 2) + F.pow(F.get(p, a)["y"] - F.get(p, b)["y"], 2))

    def sized(p: Column) -> Column:
        width, height = F.greatest(side(p, 2, 3), side(p, 1, 0)), F.greatest(side(p, 1, 2), side(p, 0, 3))
        return F.struct(F.bround(width).cast("int").alias("width"), F.bround(height).cast("int").alias("height"))

    return let(let(corners, sized), lambda s: F.when((s["width"] >= LEAST_SIDE) & (s["height"] >= LEAST_SIDE), s))


def crop_plan(points: Column, width: Column, height: Column) -> Column:
    """(corners, width, height) of a contour's crop in a frame of the given size; null where there is none."""
    out = lambda c: let(crop_size(c), lambda s: F.when(s.isNotNull(), F.struct(c.alias("corners"), s["width"].alias("width"), s["height"].alias("height"))))
    return let(ordered(points), lambda c: F.when(c.isNotNull(), let(spread(c, width, height), out)))
