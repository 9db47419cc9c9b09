"""Stage 6 queries: grid cells, polygon clipping, UTM projection.

The polygons are derived from the data: per district, the farthest point from
the district's mean in each of 64 angular sectors, in angle order, forms a
star-shaped (usually concave) ring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import from_utm, to_utm, to_utm_sql
from ..operators import polygon as pg
from ..sources.tables import POINTS_SQL, ZONES_SQL, points, with_views, zones
from ..session import cached
from .registry import query

POLY_SQL = with_views(POINTS_SQL) + """,
v AS (SELECT district_id, point_id, lon * 88 AS x, lat * 111 AS y FROM points),
c AS (SELECT district_id, avg(x) AS cx, avg(y) AS cy FROM v GROUP BY district_id),
s AS (SELECT v.district_id, v.point_id, v.x, v.y,
             CAST(least(floor((atan2(v.y - c.cy, v.x - c.cx) + pi()) / (2 * pi()) * 64.0), 63) AS INTEGER) AS sector,
             (v.x - c.cx) * (v.x - c.cx) + (v.y - c.cy) * (v.y - c.cy) AS d2
      FROM v JOIN c ON v.district_id = c.district_id),
far AS (SELECT district_id, sector, x, y
        FROM (SELECT *, row_number() OVER (PARTITION BY district_id, sector ORDER BY d2 DESC, point_id) AS rn FROM s) t
        WHERE rn = 1),
vv AS (SELECT district_id, row_number() OVER (PARTITION BY district_id ORDER BY sector) AS seq, x, y FROM far
       WHERE district_id IN (SELECT district_id FROM far GROUP BY district_id HAVING count(*) >= 3)),
e AS (SELECT district_id, seq, x AS x1, y AS y1,
             coalesce(lead(x) OVER (PARTITION BY district_id ORDER BY seq),
                      first_value(x) OVER (PARTITION BY district_id ORDER BY seq)) AS x2,
             coalesce(lead(y) OVER (PARTITION BY district_id ORDER BY seq),
                      first_value(y) OVER (PARTITION BY district_id ORDER BY seq)) AS y2 FROM vv),
bb AS (SELECT district_id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM vv GROUP BY district_id),
cells AS (SELECT district_id, ix, iy, xmin + CAST(ix AS DOUBLE) * 0.5 + 0.25 AS cx, ymin + CAST(iy AS DOUBLE) * 0.5 + 0.25 AS cy
          FROM bb, range(0, CAST(greatest(ceil((xmax - xmin) / 0.5), 1) AS BIGINT)) r1(ix),
                   range(0, CAST(greatest(ceil((ymax - ymin) / 0.5), 1) AS BIGINT)) r2(iy))"""


def _polys(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    v = cached(pg.star_polygons(points(spark, sf_dir), "district_id"))
    bb = pg.bbox_of(v, "district_id")
    return v, bb


@query(
    "grid_cells",
    "F11 F13",
    POLY_SQL + """
SELECT district_id, CAST(count(*) AS BIGINT) AS n_cells, round(avg(cy / 111), 6) AS mean_lat,
       round(avg(cx / 88), 6) AS mean_lon, CAST(max(ix) AS INTEGER) AS max_ix, CAST(max(iy) AS INTEGER) AS max_iy
FROM cells GROUP BY district_id""",
)
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 m cells over each district polygon's box, whole-cell centroids."""
    _, bb = _polys(spark, sf_dir)
    g = pg.grid_cells(bb, "district_id")
    return g.groupBy("district_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.avg("lat"), 6).alias("mean_lat"),
        F.round(F.avg("lon"), 6).alias("mean_lon"), F.max("ix").alias("max_ix"), F.max("iy").alias("max_iy"))


@query(
    "cells_in_polygon",
    "J7 S10",
    POLY_SQL + """,
x AS (SELECT cells.district_id, cells.ix, cells.iy,
             sum(CASE WHEN ((e.y1 > cells.cy) <> (e.y2 > cells.cy))
                           AND cells.cx < e.x1 + (cells.cy - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) THEN 1 ELSE 0 END) AS k
      FROM cells JOIN e ON cells.district_id = e.district_id GROUP BY cells.district_id, cells.ix, cells.iy),
area AS (SELECT district_id, abs(sum(x1 * y2 - x2 * y1) / 2) AS a FROM e GROUP BY district_id)
SELECT x.district_id, CAST(count(*) AS BIGINT) AS n_cells, CAST(count(*) FILTER (WHERE k % 2 = 1) AS BIGINT) AS n_inside,
       round(min(area.a), 6) AS polygon_area_km2
FROM x JOIN area ON x.district_id = area.district_id GROUP BY x.district_id""",
)
def cells_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose centroid lies inside the district polygon, with the polygon's area."""
    v, bb = _polys(spark, sf_dir)
    cells = pg.grid_cells(bb, "district_id")
    ins = pg.inside_polygon(cells, pg.edges(v, "district_id"), bb, "district_id")
    area = pg.shoelace(v, "district_id").select("district_id", F.round("area_km2", 6).alias("polygon_area_km2"))
    agg = ins.groupBy("district_id").agg(F.count(F.lit(1)).alias("n_cells"),
                                         F.count(F.when(F.col("inside"), 1)).alias("n_inside"))
    return agg.join(area, "district_id", "left")


_UX, _UY = to_utm_sql("lat", "lon")


@query(
    "utm_project",
    "F12",
    with_views(ZONES_SQL) + f"""
SELECT candidate_id, round({_UX}, 2) AS utm_x, round({_UY}, 2) AS utm_y FROM zones""",
)
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees → UTM 18S metres (closed-form series as column expressions)."""
    z = zones(spark, sf_dir)
    x, y = to_utm("lat", "lon")
    return z.select("candidate_id", F.round(x, 2).alias("utm_x"), F.round(y, 2).alias("utm_y"))


@query(
    "utm_inverse",
    "F12",
    with_views(ZONES_SQL) + """
SELECT candidate_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM zones""",
)
def utm_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees → UTM 18S metres → degrees, which must give the degrees again."""
    x, y = to_utm("lat", "lon")
    z = zones(spark, sf_dir).select("candidate_id", x.alias("x"), y.alias("y"))
    lat, lon = from_utm("x", "y")
    return z.select("candidate_id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query("boundary_clip", "J7 F13")
def boundary_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact clipped area and centroid (back in degrees) of the cells that
    straddle a district boundary; the clipped areas of all cells sum to the
    polygon area."""
    v, bb = _polys(spark, sf_dir)
    part = _clipped(v, bb).where("not whole")
    return part.select("district_id", "ix", "iy", F.round("clip_area_km2", 6).alias("clip_area_km2"),
                       F.round(F.col("clip_cy") / 111.0, 6).alias("centroid_lat"),
                       F.round(F.col("clip_cx") / 88.0, 6).alias("centroid_lon"))


def _clipped(v: DataFrame, bb: DataFrame) -> DataFrame:
    edges = pg.oriented(pg.edges(v, "district_id"), "district_id")
    return pg.clipped_cells(pg.grid_cells(bb, "district_id"), edges, bb, "district_id")


@query(
    "clipped_grid",
    "J7 F13 F11",
    POLY_SQL + """,
area AS (SELECT district_id, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / 6 AS sx,
                sum((y1 + y2) * (x1 * y2 - x2 * y1)) / 6 AS sy FROM e GROUP BY district_id)
SELECT district_id, round(abs(a), 6) AS area_km2, round(sy / a / 111, 6) AS centroid_lat, round(sx / a / 88, 6) AS centroid_lon,
       true AS whole_cells_full, true AS centroids_in_cells
FROM area""",
)
def clipped_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid clipped by each district's polygon, whole and cut cells, summed up: its area and centroid are the polygon's."""
    v, bb = _polys(spark, sf_dir)
    parts = _clipped(v, bb).join(bb, "district_id")
    area = F.sum("clip_area_km2")
    x0, y0 = F.col("xmin") + F.col("ix") * pg.CELL_KM, F.col("ymin") + F.col("iy") * pg.CELL_KM
    within = F.col("clip_cx").between(x0 - 1e-9, x0 + pg.CELL_KM + 1e-9) & F.col("clip_cy").between(y0 - 1e-9, y0 + pg.CELL_KM + 1e-9)
    return parts.groupBy("district_id").agg(
        F.round(area, 6).alias("area_km2"), F.round(F.sum(F.col("clip_cy") * F.col("clip_area_km2")) / area / 111.0, 6).alias("centroid_lat"),
        F.round(F.sum(F.col("clip_cx") * F.col("clip_area_km2")) / area / 88.0, 6).alias("centroid_lon"),
        F.bool_and(~F.col("whole") | (F.abs(F.col("clip_area_km2") - pg.CELL_KM * pg.CELL_KM) < 1e-9)).alias("whole_cells_full"),
        F.bool_and(within).alias("centroids_in_cells"))
