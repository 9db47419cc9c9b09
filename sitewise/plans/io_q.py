"""Stage 2-3b queries: geocoding by gazetteer, coverage, point de-duplication,
and the file sources / sinks exercised on data derived from the given tables.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import evaluate as ev
from ..operators.joins import bounded_broadcast
from ..schema import ZONE
from ..session import cached, ensure_checkpoint_dir
from ..operators import polygon as pg
from ..sources import files
from ..sources.tables import POINTS_SQL, ZONES_SQL, districts, points, with_views, zones
from .eval_q import AUC_SQL, SCORED_SQL, scored
from .registry import query

# F19 in SQL: same accent folding, trim, lower case, blank squeezing
_NORM_SQL = ("regexp_replace(lower(translate(trim({x}), '" + fx.ACCENTED + "', '" + fx.PLAIN + "')), '\\s+', ' ', 'g')")

GEO_SQL = with_views(POINTS_SQL) + f""",
named AS (SELECT p.point_id, p.kind, p.lat, p.lon,
                 {_NORM_SQL.format(x="concat_ws(', ', p.name, n.n_name)")} AS addr_key
          FROM points p LEFT JOIN nation n ON p.district_id = n.n_nationkey),
gaz AS (SELECT addr_key, min(lat) AS g_lat, min(lon) AS g_lon FROM named WHERE kind <> 'parks' GROUP BY addr_key),
geo AS (SELECT named.point_id, named.addr_key, gaz.g_lat AS latitude, gaz.g_lon AS longitude
        FROM named LEFT JOIN gaz ON named.addr_key = gaz.addr_key)"""


def geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised address key (F18 + F19) looked up in a gazetteer.

    The gazetteer is the table of known places (here: the non-park points
    with their coordinates); addresses without an entry get NULL.
    """
    d = bounded_broadcast(districts(spark, sf_dir).select("district_id", "district_name"))
    p = points(spark, sf_dir).join(d, "district_id", "left")
    named = p.select("point_id", "kind", "lat", "lon",
                     fx.normalize_name(fx.address_key("name", "district_name")).alias("addr_key"))
    gaz = named.where(F.col("kind") != "parks").groupBy("addr_key").agg(
        F.min("lat").alias("latitude"), F.min("lon").alias("longitude"))
    return named.select("point_id", "addr_key").join(gaz, "addr_key", "left")


@query(
    "geocode_lookup",
    "J10 F18 F19",
    GEO_SQL + "\nSELECT point_id, addr_key, latitude, longitude FROM geo",
)
def geocode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geocoded(spark, sf_dir).select("point_id", "addr_key", "latitude", "longitude")


@query(
    "geocode_coverage",
    "P1 A19",
    GEO_SQL + """
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS BIGINT) AS valid,
       CAST(count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS BIGINT) AS missing,
       CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
                                         / count(*), 2) ELSE 0.0 END AS pct_valid
FROM geo""",
)
def geocode_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geocoded(spark, sf_dir)
    ok = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return g.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(ok, 1)).alias("valid"),
                 F.count(F.when(~ok, 1)).alias("missing"),
                 F.when(F.count(F.lit(1)) > 0, F.round(100.0 * F.count(F.when(ok, 1)) / F.count(F.lit(1)), 2))
                 .otherwise(F.lit(0.0)).alias("pct_valid"))


@query(
    "dedupe_points",
    "A24 P1",
    with_views(POINTS_SQL) + """
SELECT round(lat, 3) AS lat3, round(lon, 3) AS lon3, min(point_id) AS keeper_id, CAST(count(*) AS BIGINT) AS n_points
FROM points WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2""",
)
def dedupe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points de-duplicated by coordinate (to ~100 m), the smallest id kept.

    A grouped ``min`` (partial aggregation before the shuffle) rather than a
    ranked window: a hot location costs one row per map task.
    """
    p = points(spark, sf_dir).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return p.groupBy(F.round("lat", 3).alias("lat3"), F.round("lon", 3).alias("lon3")).agg(
        F.min("point_id").alias("keeper_id"), F.count(F.lit(1)).alias("n_points"))


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex}")


@query(
    "csv_roundtrip",
    "S1 S2 S4",
    with_views(ZONES_SQL) + """
SELECT candidate_id, district_id, address || ' Ñandú é' AS address, lat, lon, walkability_score FROM zones""",
)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with accented text written as Latin-1 CSV and read back with an explicit schema."""
    z = zones(spark, sf_dir).select("candidate_id", "district_id", F.concat("address", F.lit(" Ñandú é")).alias("address"), "lat", "lon", "walkability_score")
    path = _scratch(spark, "csv")
    files.write_csv(z, path, encoding="ISO-8859-1")
    return files.read_csv(spark, path, z.schema, encoding="ISO-8859-1")


@query(
    "resolve_source",
    "S3",
    """SELECT c_nationkey AS district_id, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1""",
)
def resolve_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefer a materialised table, else the raw one; the raw one exists here."""
    src = files.resolve_source(spark, f"{sf_dir}/customer_materialized.parquet", f"{sf_dir}/customer.parquet")
    return spark.read.parquet(src).groupBy(F.col("c_nationkey").alias("district_id")).agg(
        F.count(F.lit(1)).alias("n"))


@query(
    "run_log",
    "S6 M7",
    SCORED_SQL.replace("prob_optimal AS prob,", "round(prob_optimal, 4) AS prob,") + f"""
SELECT 'rounded' AS split, auc_roc, 0.74::DOUBLE AS threshold FROM ({AUC_SQL}) a""",
)
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two run records over the whole scored table (AUC of the raw and of the
    4-digit score) appended to a runs table, and the latest one read back."""
    s = cached(scored(spark, sf_dir))
    path = _scratch(spark, "runs")
    for name, col in (("raw", F.col("prob")), ("rounded", F.round("prob", 4))):
        a = ev.auc(s.withColumn("prob", col)).first()
        files.append_run(spark, path, {"split": name, "auc_roc": a["auc_roc"], "threshold": 0.74})
    latest = files.latest_run(spark, path)
    return latest.select(F.get_json_object("record", "$.split").alias("split"),
                         F.round(F.get_json_object("record", "$.auc_roc").cast("double"), 6).alias("auc_roc"),
                         F.get_json_object("record", "$.threshold").cast("double").alias("threshold"))


@query(
    "boundary_source",
    "S10",
    with_views(ZONES_SQL) + """,
b AS (SELECT district_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM zones GROUP BY district_id)
SELECT CAST(district_id AS VARCHAR) AS name, 0 AS ring, k AS seq,
       round(CASE WHEN k IN (0, 3) THEN w ELSE e END, 9) AS x1, round(CASE WHEN k < 2 THEN s ELSE n END, 9) AS y1,
       round(CASE WHEN k IN (2, 3) THEN w ELSE e END, 9) AS x2, round(CASE WHEN k IN (0, 3) THEN s ELSE n END, 9) AS y2
FROM b, (SELECT CAST(unnest(range(4)) AS INTEGER) AS k) t""",
)
def boundary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each district's bounding box written as a GeoJSON place and read as edges; places that are points are skipped."""
    b = zones(spark, sf_dir).groupBy("district_id").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.to_json(F.array(F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))))
    name = F.col("district_id").cast("string")
    place = F.concat(F.lit('{"name":"'), name, F.lit('","geojson":{"type":"Polygon","coordinates":'), ring, F.lit("}}"))
    point = F.concat(F.lit('{"name":"'), name, F.lit('","geojson":{"type":"Point","coordinates":'), F.to_json(corner("w", "s")), F.lit("}}"))
    path = _scratch(spark, "boundary")
    b.select(F.explode(F.array(place, point)).alias("value")).write.text(path)  # a place a line
    e = files.boundary_edges(spark, path, lines=True)
    return e.select("name", "ring", "seq", *[F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "boundary_multipart",
    "S10 J7",
    with_views(ZONES_SQL) + """,
b AS (SELECT district_id, (max(lon) - min(lon)) * 88 AS w, (max(lat) - min(lat)) * 111 AS h FROM zones GROUP BY district_id)
SELECT CAST(district_id AS VARCHAR) AS name, 2 AS parts, 12 AS n_edges, round(w * h * (1 - 0.25 + 0.01), 6) AS area_km2,
       round(w * h * (1 - 0.25 + 0.01), 6) AS clipped_km2
FROM b""",
)
def boundary_multipart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each district as a MultiPolygon: its box with a hole of a quarter of its area in the middle, and a box of a tenth of the sides beside it.

    Read from GeoJSON in any ring direction; the area of the rings, and the same from the grid clipped by them.
    """
    b = zones(spark, sf_dir).groupBy("district_id").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    x = lambda t: F.col("w") + (F.col("e") - F.col("w")) * t
    y = lambda t: F.col("s") + (F.col("n") - F.col("s")) * t
    box = lambda a, c: F.array(*[F.array(x(i), y(j)) for i, j in ((a, a), (c, a), (c, c), (a, c), (a, a))])
    beside = F.array(*[F.array(x(i), y(j)) for i, j in ((1.2, 0.5), (1.2, 0.6), (1.3, 0.6), (1.3, 0.5), (1.2, 0.5))])
    shape = F.to_json(F.array(F.array(box(0.0, 1.0), box(0.25, 0.75)), F.array(beside)))
    name = F.col("district_id").cast("string")
    path = _scratch(spark, "boundary")
    b.select(F.concat(F.lit('{"name":"'), name, F.lit('","geojson":{"type":"MultiPolygon","coordinates":'), shape, F.lit("}}"))).write.text(path)
    e = files.boundary_edges(spark, path, lines=True)
    km = e.select("name", "part", "ring", *[(F.col(c) * k).alias(c) for k, cs in ((88.0, ("x1", "x2")), (111.0, ("y1", "y2"))) for c in cs])
    turned = pg.oriented(km, "name", "part", "ring")
    box_of = km.groupBy("name").agg(F.min("x1").alias("xmin"), F.min("y1").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"))
    clipped = pg.clipped_cells(pg.grid_cells(box_of, "name"), turned, box_of, "name").groupBy("name").agg(F.round(F.sum("clip_area_km2"), 6).alias("clipped_km2"))
    counts = e.groupBy("name").agg(F.countDistinct("part").cast("int").alias("parts"), F.count("*").cast("int").alias("n_edges"))
    area = pg.ring_area(turned, "name").select("name", F.round("area_km2", 6).alias("area_km2"))
    return counts.join(area, "name").join(clipped, "name")


@query(
    "records_to_zones",
    "S8 S9",
    with_views(ZONES_SQL) + """
SELECT population_density, nse_ab_pct, dist_nearest_road_m, walkability_score, waste_per_capita_kg,
       CAST(land_use_encoded AS BIGINT) AS land_use_encoded, CAST(NULL AS DOUBLE) AS area_m2
FROM zones ORDER BY candidate_id LIMIT 5""",
)
def records_to_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 5 zones (a head scan) → JSON records → zone table with the request schema."""
    z = zones(spark, sf_dir)
    recs = files.head_records(z.select("candidate_id", *[c for c in z.columns if c in ZONE.fieldNames()]),
                              5, ["candidate_id"])
    t = files.json_records_to_zones(recs, "record")
    return t.select("population_density", "nse_ab_pct", "dist_nearest_road_m", "walkability_score",
                    "waste_per_capita_kg", "land_use_encoded", "area_m2")
