"""Regions of points: boxes and polygons covered by grid cells of fitting size.

A shape is listed at the grid level whose cells fit its size, so in a bounded number of cells
however large or small it is, one row per cell and shape. The levels in use are few, at most
the binary range of the shapes' sizes; a point is looked up once per level.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.functions.scalars import fresh
from polderlake.operators.joins import BROADCAST_BYTES, fits_broadcast, skew_safe_join
from polderlake.session import scratch_path

# A polygon's longer side spans between half as many and as many cells.
DETAIL = 8


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _level(size: Column, cell: float) -> Column:
    return F.ceil(F.log2(size / F.lit(float(cell)))).cast("int")


def _listed(shapes: DataFrame, cell: float) -> DataFrame:
    """One row per shape and cell that its bounds meet: adds ``size, cx, cy``."""
    sized = shapes.withColumn("size", F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("level")))
    at = lambda c: F.floor(F.col(c) / F.col("size"))
    return (sized.withColumn("cx", F.explode(F.sequence(at("x_min"), at("x_max"))))
            .withColumn("cy", F.explode(F.sequence(at("y_min"), at("y_max")))))


def _assign(points: DataFrame, cells: DataFrame, levels: Sequence[int], x: str, y: str,
            cell: float, how: str, region: str, max_bytes: int,
            inside: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Points with the region of each cell row (``level, cx, cy, region_of, shape``) that holds
    them by ``inside``; with ``how="left"`` a point in none stays once, with a null region.

    No list of shapes is gathered: matches come from one equi-join on the cells of all levels,
    the points without one are those that no level's join keeps back.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"join type not supported here: {how}")
    keys = [fresh(n, points, cells) for n in ("_level", "_cx", "_cy")]
    found, shape = fresh("_found", points, cells), fresh("_shape", points, cells)
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    placed = _finite(px) & _finite(py)
    named = cells.select(*[F.col(c).alias(k) for c, k in zip(("level", "cx", "cy"), keys)],
                         F.col("region_of").alias(found), F.col("shape").alias(shape))
    cell_of = lambda level: F.struct(*[
        v.alias(k) for v, k in zip((F.lit(level), *(
            F.floor(c / F.lit(float(cell) * 2.0 ** level)) for c in (px, py))), keys)])
    met = fresh("_met", points, cells)
    columns = [F.col(c) for c in points.columns if c != region]
    kind = dict(named.dtypes)[found]
    if not levels:
        none = points.select(*columns, F.lit(None).cast(kind).alias(region))
        return none if how == "left" else none.limit(0)
    small = fits_broadcast(named, max_bytes)
    holds = inside(px, py, F.col(shape))
    looked = points.where(placed).withColumn(met, F.explode(F.array(*map(cell_of, levels))))
    looked = looked.select(*points.columns, f"{met}.*")
    matched = (looked.join(F.broadcast(named), keys) if small
               else skew_safe_join(looked, named, keys, "inner", "salted"))
    matched = matched.where(holds).select(*columns, F.col(found).alias(region))
    if how == "inner":
        return matched
    lone = points
    for level in levels:
        at = cell_of(level)
        own = named.where(F.col(keys[0]) == level)
        same = [F.coalesce(placed, F.lit(False)), holds, *[
            at[k] == F.col(k) for k in keys[1:]]]
        lone = lone.join(F.broadcast(own) if small else own,
                         reduce(lambda a, b: a & b, same), "left_anti")
    return matched.unionByName(lone.select(*columns, F.lit(None).cast(kind).alias(region)))


def assign_region(points: DataFrame, boxes: DataFrame, x: str, y: str, cell: float,
                  how: str = "left", region: str = "region_id",
                  max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Region of each point, by an equi-join on grid cells refined by the box bounds.

    ``boxes`` holds ``region, x_min, y_min, x_max, y_max``, upper bounds exclusive; boxes without
    an area or with a bound that is null or not finite hold nothing. A box lies in at most four
    cells. A point in overlapping boxes appears once per box, a point in none or without finite
    coordinates keeps a null region with ``how="left"``.
    """
    bounds = ("x_min", "y_min", "x_max", "y_max")
    width, height = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    listed = boxes.select(F.col(region).alias("region_of"),
                          *[F.col(c).cast("double").alias(c) for c in bounds])
    listed = listed.where(reduce(lambda a, b: a & b, [_finite(F.col(c)) for c in bounds])
                          & (width > 0) & (height > 0))
    listed = listed.withColumn("level", _level(F.greatest(width, height), cell))
    levels = sorted(r["level"] for r in listed.select("level").distinct().collect())
    cells = _listed(listed, cell).withColumn("shape", F.struct(*bounds))
    return _assign(points, cells, levels, x, y, cell, how, region, max_bytes, lambda px, py, s: (
        (px >= s["x_min"]) & (px < s["x_max"]) & (py >= s["y_min"]) & (py < s["y_max"])))


def edges_of(rings: Column) -> Column:
    """Edges ``ax, ay, bx, by`` of all rings; a ring that is not closed is closed."""
    point = lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))

    def of_ring(ring: Column) -> Column:
        """The edge from each point to the next, from the last to the first; of a closed ring
        that one has no length and is crossed by nothing."""
        def edge(p: Column, i: Column) -> Column:
            q = F.get(ring, (i + 1) % F.size(ring))
            return F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))
        return F.transform(ring, edge)

    good = F.filter(F.transform(rings, lambda ring: F.transform(ring, point)),
                    lambda ring: F.size(ring) >= 3)
    return F.flatten(F.transform(good, of_ring))


def crossed(px: Column, py: Column, edges: Column) -> Column:
    """Whether a ray to the right crosses an odd number of edges: even-odd rule, holes too.

    An edge counts its lower end and not its upper one, so a point on the border that two
    regions share lies in one of them.
    """
    hit = lambda e: ((e["ay"] > py) != (e["by"] > py)) & (
        px < (e["bx"] - e["ax"]) * (py - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    # The second test is not reached for a level edge, which the first one turns down.
    safe = lambda e: F.when((e["ay"] > py) != (e["by"] > py), hit(e)).otherwise(F.lit(False))
    return F.size(F.filter(edges, safe)) % 2 == 1


def polygon_cells(polygons: DataFrame, cell: float, region: str = "region_id",
                  rings: str = "rings", detail: int = DETAIL) -> DataFrame:
    """``level, cx, cy, region_of, shape``: the cells that a polygon covers or cuts.

    A cell that no edge meets lies wholly inside (``shape.whole``) or is left out; a cell that is
    cut carries the edges a ray from within it can cross, those of its height.
    """
    e = F.col("edges")
    low = lambda a, b: F.array_min(F.transform(e, lambda s: F.least(s[a], s[b])))
    high = lambda a, b: F.array_max(F.transform(e, lambda s: F.greatest(s[a], s[b])))
    shapes = polygons.select(F.col(region).alias("region_of"), edges_of(F.col(rings)).alias("edges"))
    shapes = shapes.where(F.size("edges") > 0).where(F.forall("edges", lambda s: F.coalesce(
        _finite(s["ax"]) & _finite(s["ay"]) & _finite(s["bx"]) & _finite(s["by"]), F.lit(False))))
    shapes = shapes.withColumns({"x_min": low("ax", "bx"), "x_max": high("ax", "bx"),
                                 "y_min": low("ay", "by"), "y_max": high("ay", "by")})
    span = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    shapes = shapes.where(span > 0).withColumn("level", _level(span / detail, cell))
    listed = _listed(shapes, cell)
    x0, y0, size = F.col("cx") * F.col("size"), F.col("cy") * F.col("size"), F.col("size")
    x1, y1 = x0 + size, y0 + size

    def cuts(s: Column) -> Column:
        """Whether the edge meets the closed cell: overlapping bounds, corners not on one side."""
        side = lambda cx, cy: ((s["bx"] - s["ax"]) * (cy - s["ay"])
                               - (s["by"] - s["ay"]) * (cx - s["ax"]))
        corners = [side(a, b) for a in (x0, x1) for b in (y0, y1)]
        return ((F.least(s["ax"], s["bx"]) <= x1) & (F.greatest(s["ax"], s["bx"]) >= x0)
                & (F.least(s["ay"], s["by"]) <= y1) & (F.greatest(s["ay"], s["by"]) >= y0)
                & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0))

    near = F.filter(e, lambda s: (F.least(s["ay"], s["by"]) <= y1) & (F.greatest(s["ay"], s["by"]) >= y0))
    cut = F.exists(e, cuts)
    whole = ~cut & crossed(x0 + size / 2, y0 + size / 2, e)
    kept = listed.withColumns({"cut": cut, "whole": whole}).where("cut OR whole")
    return kept.select("level", "cx", "cy", "region_of", F.struct(
        "whole", F.when(F.col("cut"), near).otherwise(F.slice(e, 1, 0)).alias("edges")).alias("shape"))


def assign_polygon(points: DataFrame, polygons: DataFrame, x: str, y: str, cell: float,
                   how: str = "left", region: str = "region_id", rings: str = "rings",
                   detail: int = DETAIL, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Region of each point by polygons with holes: ``rings`` as in GeoJSON, arrays of arrays of
    coordinates; the parts of a multi-part region are rows of their own.

    Points in cells wholly inside are accepted at once, in cut cells the ray test decides. Rings
    of fewer than three points, and polygons with a coordinate that is null or not finite, hold
    nothing. Points and ``how`` are treated as by ``assign_region``.
    """
    # Staged: a bounded number of cells per polygon, laid out once and read by each join.
    path = scratch_path(points.sparkSession, "polygon-cells")
    polygon_cells(polygons, cell, region, rings, detail).write.parquet(path)
    cells = points.sparkSession.read.parquet(path)
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())
    return _assign(points, cells, levels, x, y, cell, how, region, max_bytes, lambda px, py, s: (
        s["whole"] | crossed(px, py, s["edges"])))
