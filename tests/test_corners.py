"""Corners of labels against plain arithmetic."""

import math
import random

from pyspark.sql import functions as F

from waybill.operators import corners


def plain(points, width, height):
    if points is None or len(points) != 4:
        return None
    sums, gaps = [x + y for x, y in points], [y - x for x, y in points]
    at = [sums.index(min(sums)), gaps.index(min(gaps)), sums.index(max(sums)), gaps.index(max(gaps))]
    if len(set(at)) != 4:
        return None
    chosen = [points[i] for i in at]
    cx, cy = (sum(p[k] for p in chosen) / 4 for k in (0, 1))
    moved = [(min(max(cx + (x - cx) * 1.03, 0), width - 1), min(max(cy + (y - cy) * 1.03, 0), height - 1)) for x, y in chosen]
    side = lambda a, b: math.dist(moved[a], moved[b])
    size = round(max(side(2, 3), side(1, 0))), round(max(side(1, 2), side(0, 3)))
    return (moved, *size) if min(size) >= 20 else None


def test_crops_of_contours(spark):
    rng = random.Random(8)
    quads = [[(rng.uniform(-20, 400), rng.uniform(-20, 300)) for _ in range(4)] for _ in range(300)]
    quads += [[(0.0, 0.0), (100.0, 0.0), (100.0, 50.0), (0.0, 50.0)], [(0.0, 50.0), (100.0, 50.0), (0.0, 0.0), (100.0, 0.0)], [(0.0, 0.0)] * 4, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [(1.0, 2.0)] * 3, None, []]
    rows = spark.createDataFrame(list(enumerate(quads)), f"i int, points array<{corners.POINT}>")
    got = {r.i: r.c for r in rows.select("i", corners.crop_plan(F.col("points"), F.lit(320), F.lit(240)).alias("c")).collect()}
    want = {i: plain(q, 320, 240) for i, q in enumerate(quads)}
    assert {i for i, c in got.items() if c} == {i for i, w in want.items() if w} and sum(w is not None for w in want.values()) > 50
    for i, w in want.items():
        if w:
            assert (got[i].width, got[i].height) == w[1:]
            assert all(math.isclose(p.x, x, abs_tol=1e-9) and math.isclose(p.y, y, abs_tol=1e-9) for p, (x, y) in zip(got[i].corners, w[0], strict=True))
    assert [(p.x, p.y) for p in spark.range(1).select(corners.ordered(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in quads[301]]))).first()[0]] == [(0.0, 0.0), (100.0, 0.0), (100.0, 50.0), (0.0, 50.0)]
