import random

import pytest
from conftest import collect
from pyspark.sql import functions as F

from polderlake.operators import regions

POINTS = "id long, x double, y double, region_old string, _level int, size int"


def points_frame(spark, points):
    return spark.createDataFrame([(i, x, y, "old", 5, 6) for i, (x, y) in enumerate(points)], POINTS)


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def random_polygons(seed, n):
    """Star-shaped rings of random size, some closed, some with a hole, some in parts."""
    import math
    r = random.Random(seed)
    out = []
    for i in range(n):
        cx, cy, size = r.uniform(-4, 4), r.uniform(-4, 4), 2.0 ** r.uniform(-5, 3)
        ring = lambda s: [(cx + s * size * r.uniform(0.4, 1) * math.cos(a / 9 * 2 * math.pi),
                           cy + s * size * r.uniform(0.4, 1) * math.sin(a / 9 * 2 * math.pi)) for a in range(9)]
        rings = [ring(1.0)]
        if i % 3 == 0:
            rings.append(ring(0.3))
        if i % 2:
            rings = [x + x[:1] for x in rings]
        out.append((f"r{i % (n - 3)}", rings))
    out.append(("square", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]))
    out.append(("next", [[(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]]))
    return out


@pytest.mark.parametrize("how,limit", [("left", 1 << 20), ("left", 0), ("inner", 0)])
def test_polygons_equal_brute_force(spark, how, limit):
    r = random.Random(7)
    shapes = random_polygons(3, 14)
    points = [(r.uniform(-6, 6), r.uniform(-6, 6)) for _ in range(1_000)]
    points += [(0.5, 0.5)] * 200 + [(1.0, 0.5), (0.0, 0.0), (2.0, 1.0), (1.0, 1.0), (0.5, 0.0)]
    points += [(None, 1.0), (float("nan"), 0.0), (float("inf"), 0.0)]
    rows = [(n, [[list(p) for p in ring] for ring in rings]) for n, rings in shapes]
    rows += [("none", None), ("empty", []), ("line", [[[0.0, 0.0], [1.0, 1.0]]]), ("hole", [[None, None, None]])]
    df = spark.createDataFrame(rows, "region_id string, rings array<array<array<double>>>")
    got = regions.assign_polygon(points_frame(spark, points), df, "x", "y", cell=0.7, how=how, max_bytes=limit)
    want = []
    for i, (x, y) in enumerate(points):
        ok = x is not None and x == x and abs(x) != float("inf")
        hits = [n for n, rings in shapes if ok and inside(x, y, rings)]
        want += [(i, h) for h in hits or ([None] if how == "left" else [])]
    assert collect(got.select("id", "region_id")) == sorted(want, key=repr)
    assert got.columns == ["id", "x", "y", "region_old", "_level", "size", "region_id"]


def test_cells_of_a_polygon_are_bounded_whatever_its_size(spark):
    square = lambda s: [[[0.0, 0.0], [s, 0.0], [s, s], [0.0, s]]]
    df = spark.createDataFrame([(str(s), square(s)) for s in (1e-3, 1.0, 1e6)],
                               "region_id string, rings array<array<array<double>>>")
    cells = regions.polygon_cells(df, 0.5)
    counts = {r["region_of"]: r["count"] for r in cells.groupBy("region_of").count().collect()}
    assert len(counts) == 3 and max(counts.values()) <= (regions.DETAIL + 2) ** 2
    assert cells.where("shape.whole").count() > 0
    assert cells.where("shape.whole AND size(shape.edges) > 0").count() == 0


def test_many_small_boxes_do_not_share_a_cell(spark):
    boxes = spark.range(400).select(
        F.col("id").cast("string").alias("region_id"), (F.col("id") % 20 * 0.01).alias("x_min"),
        (F.col("id") % 20 * 0.01 + 0.01).alias("x_max"), (F.floor(F.col("id") / 20) * 0.01).alias("y_min"),
        (F.floor(F.col("id") / 20) * 0.01 + 0.01).alias("y_max"))
    points = points_frame(spark, [(0.005 + 0.01 * (i % 20), 0.005 + 0.01 * (i // 20)) for i in range(400)])
    got = regions.assign_region(points, boxes, "x", "y", cell=1.0)
    assert got.count() == 400 and got.where("region_id = cast(id as string)").count() == 400
    assert regions.assign_region(points, boxes.limit(0), "x", "y", cell=1.0).where(
        "region_id is null").count() == 400
