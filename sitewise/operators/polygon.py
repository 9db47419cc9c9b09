"""Grid cells and polygon clipping (F11, F13, J7, S10) in flat-km space.

Coordinates are x = lon·88, y = lat·111 (the flat approximation used for
every distance), cells are 0.5 km squares over a bounding box with
half-open ranges.  Point-in-polygon is ray casting on the cell centroid:
edges are copied to the cell rows (``iy``) they span, so a cell meets only
the edges of its own row through an equi-join on (polygon, iy) instead of a
cells × edges product; the crossing parity decides inside/outside.  The
x-intercept uses ``try_divide`` (trap 29: horizontal edges).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG_LAT, KM_PER_DEG_LON

CELL_KM = 0.5


SECTORS = 64


def star_polygons(points: DataFrame, group: str, pid: str = "point_id", sectors: int = SECTORS) -> DataFrame:
    """One simple polygon per group from its points: the farthest point from
    the group's mean in each of ``sectors`` angular sectors, in angle order.

    Every point takes part, through a grouped ``max`` (partial aggregation
    before the shuffle), and the ring has at most ``sectors`` vertices, so
    later per-polygon steps (edges, rings for clipping) stay bounded however
    many points a group has.  Output ``(group, seq, x, y)`` in km; groups
    with fewer than 3 occupied sectors are dropped.
    """
    p = points.select(group, pid, (F.col("lon") * KM_PER_DEG_LON).alias("x"), (F.col("lat") * KM_PER_DEG_LAT).alias("y"))
    c = p.groupBy(group).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    j = p.join(c, group)
    ang = F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))
    sector = F.least(F.floor((ang + F.lit(math.pi)) / F.lit(2 * math.pi) * F.lit(float(sectors))),
                     F.lit(sectors - 1)).cast("int")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    far = j.groupBy(group, sector.alias("sector")).agg(
        F.max(F.struct((dx * dx + dy * dy).alias("d2"), (-F.col(pid)).alias("npid"), "x", "y")).alias("v"))
    w = Window.partitionBy(group).orderBy("sector")  # ≤ sectors rows per group
    out = far.select(group, "sector", F.col("v.x").alias("x"), F.col("v.y").alias("y")).withColumns(
        {"seq": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(group))})
    return out.where(F.col("_n") >= 3).select(group, "seq", "x", "y")


def edges(vertices: DataFrame, group: str) -> DataFrame:
    """S10 form: closed ring → edge table ``(group, seq, x1, y1, x2, y2)``."""
    w = Window.partitionBy(group).orderBy("seq")
    first = F.first("x").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsty = F.first("y").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return vertices.select(
        group, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.coalesce(F.lead("x").over(w), first).alias("x2"), F.coalesce(F.lead("y").over(w), firsty).alias("y2"),
    )


def grid_cells(bbox: DataFrame, group: str, size: float = CELL_KM) -> DataFrame:
    """F11 + F13: cells over each group's box; ``np.arange`` half-open ranges.

    ``bbox`` has (group, xmin, ymin, xmax, ymax).  Output (group, ix, iy,
    x0, y0, cx, cy, lat, lon) with the whole-cell centroid in degrees.
    """
    nx = F.greatest(F.ceil((F.col("xmax") - F.col("xmin")) / size), F.lit(1)).cast("int")
    ny = F.greatest(F.ceil((F.col("ymax") - F.col("ymin")) / size), F.lit(1)).cast("int")
    g = bbox.select(group, "xmin", "ymin", F.explode(F.sequence(F.lit(0), nx - 1)).alias("ix"), ny.alias("_ny"))
    g = g.select(group, "xmin", "ymin", "ix", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)).alias("iy"))
    g = g.withColumns({"x0": F.col("xmin") + F.col("ix") * size, "y0": F.col("ymin") + F.col("iy") * size})
    g = g.withColumns({"cx": F.col("x0") + size / 2, "cy": F.col("y0") + size / 2})
    return g.withColumns({"lat": F.col("cy") / KM_PER_DEG_LAT, "lon": F.col("cx") / KM_PER_DEG_LON}).drop("xmin", "ymin")


def inside_polygon(cells: DataFrame, edge_tbl: DataFrame, bbox: DataFrame, group: str,
                   size: float = CELL_KM) -> DataFrame:
    """``inside`` = centroid inside the group's polygon (ray casting, even-odd).

    Every edge is copied to the cell rows whose centroid y lies in
    [min(y1,y2), max(y1,y2)), the half-open straddle rule, so each crossing
    is counted once; the join is an equi-join on (group, iy).
    """
    e = edge_tbl.join(bbox.select(group, "ymin"), group)
    lo = F.ceil((F.least("y1", "y2") - F.col("ymin")) / size - 0.5).cast("int")
    hi = F.ceil((F.greatest("y1", "y2") - F.col("ymin")) / size - 0.5).cast("int") - 1
    # one spare row on each side: the exact straddle test below filters them
    e = e.withColumn("iy", F.explode(F.sequence(F.greatest(lo - 1, F.lit(0)), F.greatest(hi + 1, F.lit(0)))))
    c, ee = cells.alias("c"), e.alias("e")
    j = c.join(ee, [F.col(f"c.{group}") == F.col(f"e.{group}"), F.col("c.iy") == F.col("e.iy")], "left")
    cy, cx = F.col("c.cy"), F.col("c.cx")
    y1, y2, x1, x2 = F.col("e.y1"), F.col("e.y2"), F.col("e.x1"), F.col("e.x2")
    straddle = (y1 > cy) != (y2 > cy)
    xint = x1 + F.try_divide((cy - y1) * (x2 - x1), (y2 - y1))
    cross = F.when(straddle & (cx < xint), 1).otherwise(0)
    keys = [F.col(f"c.{k}").alias(k) for k in cells.columns]
    return j.groupBy(*keys).agg((F.sum(cross) % 2 == 1).alias("inside"))


def bbox_of(vertices: DataFrame, group: str) -> DataFrame:
    return vertices.groupBy(group).agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"),
                                       F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def shoelace(vertices: DataFrame, group: str) -> DataFrame:
    """Polygon area (km²) and centroid per group by the shoelace formula."""
    e = edges(vertices, group)
    cr = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return e.groupBy(group).agg(
        (F.sum(cr) / 2).alias("_a"),
        F.sum((F.col("x1") + F.col("x2")) * cr).alias("_sx"), F.sum((F.col("y1") + F.col("y2")) * cr).alias("_sy"),
    ).select(group, F.abs("_a").alias("area_km2"), (F.col("_sx") / (6 * F.col("_a"))).alias("cx"),
             (F.col("_sy") / (6 * F.col("_a"))).alias("cy"))


def oriented(edge_tbl: DataFrame, group: str, part: str | None = None, ring: str | None = None) -> DataFrame:
    """The edges with outer rings counter-clockwise and holes clockwise.

    A ring above 0 is a hole; without ``ring`` all edges of a group are one outer ring.
    """
    keys = [group, *[c for c in (part, ring) if c]]
    turn = edge_tbl.groupBy(*keys).agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("_turn"))
    outer = (F.col(ring) == 0) if ring else F.lit(True)
    flip = (F.col("_turn") > 0) != outer
    there = {f"_{a}{i}": F.when(flip, F.col(f"{a}{3 - i}")).otherwise(F.col(f"{a}{i}")) for a in "xy" for i in (1, 2)}
    return edge_tbl.join(turn, keys).select(*keys, *[v.alias(k[1:]) for k, v in there.items()])


def ring_area(edge_tbl: DataFrame, group: str) -> DataFrame:
    """Area (km²) per group from oriented edges: outer rings less holes."""
    return edge_tbl.groupBy(group).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area_km2"))


def _pieces(edge_tbl: DataFrame, bbox: DataFrame, group: str, size: float) -> DataFrame:
    """Oriented edges cut at all grid lines: (group, ix, iy, u1, v1, u2, v2) in the cell's own frame.

    Vertical edges are left out: nothing lies under them.
    """
    e = edge_tbl.where(F.col("x1") != F.col("x2")).join(bbox.select(group, "xmin", "ymin"), group)
    e = e.select(group, *[(F.col(c) - F.col("xmin")).alias(c) for c in ("x1", "x2")], *[(F.col(c) - F.col("ymin")).alias(c) for c in ("y1", "y2")])
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    # an end on a grid line belongs to the piece before it: a stretch of no width adds nothing
    last = F.greatest(F.ceil(hi / size) - 1, F.floor(lo / size))
    e = e.withColumn("ix", F.explode(F.sequence(F.floor(lo / size).cast("int"), last.cast("int"))))
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    y_at = lambda x: F.when(x == F.col("x1"), F.col("y1")).when(x == F.col("x2"), F.col("y2")).otherwise(F.col("y1") + (x - F.col("x1")) * F.col("slope"))
    e = e.withColumns({"slope": slope, "a": F.greatest(lo, F.col("ix") * F.lit(size)), "b": F.least(hi, (F.col("ix") + 1) * F.lit(size))})
    e = e.withColumns({"ya": y_at(F.col("a")), "yb": y_at(F.col("b"))})
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    # a flat piece on a grid line lies on top of the row below
    last = (F.ceil(high / size) - 1).cast("int")
    e = e.withColumn("iy", F.explode(F.sequence(F.least(F.floor(low / size).cast("int"), last), last)))
    # x where the edge meets a row's lower and upper line, kept within the stretch
    rise = F.col("yb") - F.col("ya")
    x_at = lambda y: F.col("a") + F.least(F.greatest((y - F.col("ya")) / rise, F.lit(0.0)), F.lit(1.0)) * (F.col("b") - F.col("a"))
    bottom, top = F.col("iy") * F.lit(size), (F.col("iy") + 1) * F.lit(size)
    left = F.when(rise > 0, x_at(bottom)).when(rise < 0, x_at(top)).otherwise(F.col("a"))
    right = F.when(rise > 0, x_at(top)).when(rise < 0, x_at(bottom)).otherwise(F.col("b"))
    e = e.withColumns({"l": left, "r": right})
    in_cell = lambda y: F.least(F.greatest(y - F.col("iy") * F.lit(size), F.lit(0.0)), F.lit(size))
    ends = e.withColumns({"vl": in_cell(y_at(F.col("l"))), "vr": in_cell(y_at(F.col("r")))})
    ends = ends.withColumns({"ul": F.col("l") - F.col("ix") * F.lit(size), "ur": F.col("r") - F.col("ix") * F.lit(size)})
    ahead = F.col("x2") > F.col("x1")
    return ends.select(group, "ix", "iy", *[F.when(ahead, F.col(f"{c}{'l' if i == 1 else 'r'}")).otherwise(F.col(f"{c}{'r' if i == 1 else 'l'}")).alias(f"{c}{i}") for c in "uv" for i in (1, 2)])


def clipped_cells(cells: DataFrame, edge_tbl: DataFrame, bbox: DataFrame, group: str, size: float = CELL_KM) -> DataFrame:
    """Exact area and centroid of every cell's part inside its polygon; cells outside are left out.

    Green's theorem as grouped sums.  What lies inside a cell is what lies under the edges,
    with the sign of their direction, cut off at the cell's top: an edge's piece within
    the cell adds the trapezium under it, one in a cell above adds the full height over
    its width.  The first is a sum per cell, the second a running sum down a column of cells.
    So a polygon may have any number of vertices, parts and holes (``oriented``), and no
    ring is ever put together.

    Output (group, ix, iy, clip_area_km2, clip_cx, clip_cy, whole), whole: not cut by an edge.
    """
    u1, v1, u2, v2 = (F.col(c) for c in ("u1", "v1", "u2", "v2"))
    du = u2 - u1
    own = _pieces(edge_tbl, bbox, group, size).groupBy(group, "ix", "iy").agg(
        F.sum(du * (v1 + v2) / 2).alias("a"), F.sum(du * (2 * u1 * v1 + u1 * v2 + u2 * v1 + 2 * u2 * v2) / 6).alias("mx"),
        F.sum(du * (v1 * v1 + v1 * v2 + v2 * v2) / 6).alias("my"), F.sum(du).alias("w"), F.sum((u2 * u2 - u1 * u1) / 2).alias("wx"))
    every = cells.select(group, "ix", "iy", "x0", "y0").join(own, [group, "ix", "iy"], "left")
    above = Window.partitionBy(group, "ix").orderBy(F.desc("iy")).rowsBetween(Window.unboundedPreceding, -1)  # a column of a polygon's cells
    every = every.withColumns({"over": F.coalesce(F.sum("w").over(above), F.lit(0.0)), "overx": F.coalesce(F.sum("wx").over(above), F.lit(0.0))})
    # the upper side of a counter-clockwise ring runs to the left: inside is minus what lies under
    total = lambda c, full: -(F.coalesce(F.col(c), F.lit(0.0)) + full)
    s = F.lit(size)
    every = every.withColumns({"area": total("a", s * F.col("over")), "sx": total("mx", s * F.col("overx")), "sy": total("my", s * s / 2 * F.col("over"))})
    found = every.where(F.col("area") > 1e-12)
    return found.select(group, "ix", "iy", F.col("area").alias("clip_area_km2"), (F.col("x0") + F.col("sx") / F.col("area")).alias("clip_cx"),
                        (F.col("y0") + F.col("sy") / F.col("area")).alias("clip_cy"), (F.col("area") >= size * size - 1e-12).alias("whole"))
