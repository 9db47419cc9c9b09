"""Stage 1-2 queries: zone features, the flagship ranking, spatial joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions.geo import flat_km
from ..operators import pyramid, recommend, scoring, spatial, strips
from ..operators.joins import bounded_broadcast
from ..schema import ALL_FEATURES, add_missing, canonical_order, cast_contract, numeric_columns, unique_existing
from ..session import ensure_checkpoint_dir
from ..sources.tables import DISTRICTS_SQL, POINTS_SQL, ZONES_SQL, districts, points, with_views, zones
from .registry import dist_sql, query

# SQL: brute-force nearest distance, nearest id (smallest id on ties) and the
# strict 500 m count for every zone; the Spark side uses bucketed joins.
ZONE_FEATURES_SQL = (
    ZONES_SQL
    + ","
    + POINTS_SQL
    + f""",
pairs AS (SELECT z.candidate_id, p.point_id, {dist_sql('z', 'p')} AS d FROM zones z, points p),
nn AS (SELECT candidate_id, min(d) AS nearest_km,
              CAST(count(*) FILTER (WHERE d < CAST(0.5 AS DOUBLE)) AS BIGINT) AS n500
       FROM pairs GROUP BY candidate_id),
nid AS (SELECT q.candidate_id, min(q.point_id) AS nearest_point_id
        FROM pairs q JOIN nn ON q.candidate_id = nn.candidate_id AND q.d = nn.nearest_km
        GROUP BY q.candidate_id),
zf AS (SELECT z.*, nn.n500 AS recycling_density_1km, nn.nearest_km * 1000 AS dist_nearest_recycling_m
       FROM zones z JOIN nn ON z.candidate_id = nn.candidate_id),
scored AS (
  SELECT *, 1 / (1 + exp(0.2 - (2 * (population_density / 25000) + 1.5 * accessibility_composite
                               + 1.2 * coverage_gap_index + 0.8 * nse_high_ratio
                               - CASE WHEN recycling_density_1km IS NULL THEN NULL
                                      ELSE least(greatest(recycling_density_1km / 5, 0.0), 1.0) END))) AS prob_optimal
  FROM (SELECT *, CAST(recycling_deficit AS DOUBLE) AS coverage_gap_index
        FROM (SELECT *,
                     0.6 * walkability_score + 0.4 * (1 - least(greatest(dist_nearest_road_m / 300, 0.0), 1.0)) AS accessibility_composite,
                     nse_ab_pct AS nse_high_ratio,
                     CAST(coalesce(dist_nearest_recycling_m >= 500, false) AS INTEGER) AS recycling_deficit
              FROM zf) a) b)"""
)


def zone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the address text is not a feature: keep it out of the spatial shuffles
    return scoring.zone_features(zones(spark, sf_dir).drop("address"), points(spark, sf_dir))


def zone_table_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone feature table written once and reused by downstream stages
    (profiling, datasets, evaluation, model): they read Parquet instead of
    re-running the spatial joins."""
    import sys

    from ..functions import features as _fx
    from ..functions import geo as _geo
    from ..sources import tables as _tables
    from ..sources.materialize import materialized

    code = [sys.modules[__name__], scoring, spatial, pyramid, strips, _fx, _geo, _tables]
    return materialized(spark, "zone_features", [f"{sf_dir}/customer.parquet", f"{sf_dir}/supplier.parquet"],
                        lambda: zone_table(spark, sf_dir), code=code)


def scored_zones(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    z = zone_table_stored(spark, sf_dir) if stored else zone_table(spark, sf_dir)
    return scoring.score_zones(scoring.derive(z))


@query(
    "top_zones",
    "J4 J5 F3 F5 F6 F14 F15 F17 M6 K1",
    with_views(ZONE_FEATURES_SQL)
    + """
SELECT candidate_id, district_id, round(prob_optimal, 4) AS suitability_score,
       prob_optimal >= 0.74 AS is_recommended, recycling_density_1km,
       round(dist_nearest_recycling_m, 4) AS dist_nearest_recycling_m
FROM scored ORDER BY round(prob_optimal, 4) DESC NULLS LAST, candidate_id LIMIT 10""",
)
def top_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: top 10 zones by the noise-free suitability score."""
    top = recommend.top_n(scored_zones(spark, sf_dir), 10)
    return top.select(
        "candidate_id", "district_id", "suitability_score", "is_recommended", "recycling_density_1km",
        F.round("dist_nearest_recycling_m", 4).alias("dist_nearest_recycling_m"),
    )


@query(
    "suitability_score",
    "F14 F15 F17 M6",
    with_views(ZONE_FEATURES_SQL)
    + """
SELECT candidate_id, round(prob_optimal, 4) AS suitability_score, prob_optimal >= 0.74 AS is_recommended,
       round(accessibility_composite, 6) AS accessibility_composite, recycling_deficit, coverage_gap_index
FROM scored""",
)
def suitability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_zones(spark, sf_dir)
    return s.select(
        "candidate_id", "suitability_score", "is_recommended",
        F.round("accessibility_composite", 6).alias("accessibility_composite"), "recycling_deficit", "coverage_gap_index",
    )


@query(
    "nearest_point",
    "J4 F10",
    with_views(ZONE_FEATURES_SQL)
    + """
SELECT zf.candidate_id, nid.nearest_point_id, round(zf.dist_nearest_recycling_m, 4) AS dist_nearest_recycling_m
FROM zf JOIN nid ON zf.candidate_id = nid.candidate_id""",
)
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zones(spark, sf_dir).select("candidate_id", "lat", "lon")
    nn = spatial.nearest(z, points(spark, sf_dir), dist_col="nearest_km", id_col="nearest_point_id")
    return nn.select("candidate_id", "nearest_point_id",
                     F.round(F.col("nearest_km") * 1000.0, 4).alias("dist_nearest_recycling_m"))


@query(
    "points_within_500m",
    "J5",
    with_views(ZONE_FEATURES_SQL) + "\nSELECT candidate_id, recycling_density_1km FROM zf",
)
def points_within_500m(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zones(spark, sf_dir).select("candidate_id", "lat", "lon")
    c = spatial.count_within(z, points(spark, sf_dir), 0.5, out="recycling_density_1km")
    return c.select("candidate_id", "recycling_density_1km")


@query(
    "points_arriving",
    "§2.12 J5 J4",
    with_views(ZONES_SQL, POINTS_SQL)
    + f"""
SELECT z.candidate_id, CAST(count(p.point_id) AS BIGINT) AS points_500m, round(min({dist_sql('z', 'p')}), 9) AS nearest_km
FROM zones z LEFT JOIN points p ON {dist_sql('z', 'p')} < CAST(0.5 AS DOUBLE)
GROUP BY z.candidate_id""",
)
def points_arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts within 500 m kept up to date by a stream of points, which come in two deliveries and several batches."""
    from ..streaming import point_stream

    z, p = zones(spark, sf_dir).select("candidate_id", "lat", "lon"), points(spark, sf_dir).select("point_id", "lat", "lon")
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    for late in (False, True):
        part = p.where((F.col("point_id") % 3 == 0) == late).repartition(3, "point_id")
        part.write.mode("append").parquet(f"{base}/in")
        point_stream.follow(spark, f"{base}/in", p.schema, z, 0.5, "candidate_id", f"{base}/out", f"{base}/chk", files_per_batch=2)
    found = point_stream.counts(spark, f"{base}/out", z, "candidate_id", "points_500m")
    return found.select("candidate_id", "points_500m", F.round("nearest_km", 9).alias("nearest_km"))


@query(
    "points_within_1km",
    "J9 J5",
    with_views(ZONES_SQL, POINTS_SQL)
    + f"""
SELECT z.candidate_id,
       CAST(count(p.point_id) AS BIGINT) AS points_1km
FROM zones z LEFT JOIN points p ON {dist_sql('z', 'p')} < CAST(1.0 AS DOUBLE)
GROUP BY z.candidate_id""",
)
def points_within_1km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A true 1 km count (the contract's ``recycling_density_1km`` holds the
    500 m count, trap 17; this is the radius its name promises)."""
    z = zones(spark, sf_dir).select("candidate_id", "lat", "lon")
    return spatial.count_within(z, points(spark, sf_dir), 1.0, out="points_1km").select("candidate_id", "points_1km")


@query(
    "self_nearest",
    "J3 J5",
    with_views(POINTS_SQL)
    + f""",
pairs AS (SELECT a.point_id, {dist_sql('a', 'b')} AS d FROM points a JOIN points b ON a.point_id <> b.point_id)
SELECT p.point_id, round(min(q.d) * 1000, 4) AS dist_to_nearest_point_m,
       CAST(count(*) FILTER (WHERE q.d < CAST(0.5 AS DOUBLE)) AS BIGINT) AS existing_points_500m
FROM points p JOIN pairs q ON p.point_id = q.point_id GROUP BY p.point_id""",
)
def self_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest other point (self excluded by id) and strict 500 m count of others."""
    p = points(spark, sf_dir).select("point_id", "lat", "lon")
    nn = spatial.nearest(p, p, dist_col="nearest_km", id_col=None, self_exclude=True)
    c = spatial.count_within(nn, p, 0.5, out="existing_points_500m", self_id="point_id")
    return c.select("point_id", F.round(F.col("nearest_km") * 1000.0, 4).alias("dist_to_nearest_point_m"),
                    "existing_points_500m")


@query(
    "proximity_label",
    "J6 L1",
    with_views(ZONES_SQL, POINTS_SQL)
    + f"""
SELECT z.candidate_id,
       CAST(EXISTS (SELECT 1 FROM points p WHERE {dist_sql('z', 'p')} <= CAST(0.3 AS DOUBLE)) AS INTEGER) AS is_suitable
FROM zones z""",
)
def proximity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 when a point lies within 300 m (inclusive), else 0."""
    z = zones(spark, sf_dir).select("candidate_id", "lat", "lon")
    lab = spatial.exists_within(z, points(spark, sf_dir), scoring.LABEL_RADIUS_KM, out="is_suitable", inclusive=True)
    return lab.select("candidate_id", "is_suitable")


@query(
    "coverage_gap",
    "A23 J5",
    with_views(ZONE_FEATURES_SQL)
    + """
SELECT district_id,
       round(sum(CASE WHEN recycling_density_1km = 0 THEN population_density ELSE 0 END) / sum(population_density), 6) AS coverage_gap,
       CAST(count(*) AS BIGINT) AS n_zones
FROM zf GROUP BY district_id""",
)
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of population (zone density as weight) with no point within 500 m."""
    z = zones(spark, sf_dir).select("candidate_id", "district_id", "lat", "lon", "population_density")
    c = spatial.count_within(z, points(spark, sf_dir), 0.5, out="n500")
    return c.groupBy("district_id").agg(
        F.round(F.sum(F.when(F.col("n500") == 0, F.col("population_density")).otherwise(0.0))
                / F.sum("population_density"), 6).alias("coverage_gap"),
        F.count(F.lit(1)).alias("n_zones"),
    )


@query(
    "poi_density_pivot",
    "J9",
    with_views(ZONES_SQL, POINTS_SQL)
    + f""",
pairs AS (SELECT z.candidate_id, p.kind FROM zones z JOIN points p ON {dist_sql('z', 'p')} < CAST(0.5 AS DOUBLE))
SELECT z.candidate_id,
       CAST(count(q.kind) FILTER (WHERE q.kind = 'commercial') AS BIGINT) AS poi_commercial_500m,
       CAST(count(q.kind) FILTER (WHERE q.kind = 'educational') AS BIGINT) AS poi_educational_500m,
       CAST(count(q.kind) FILTER (WHERE q.kind = 'parks') AS BIGINT) AS poi_parks_500m
FROM zones z LEFT JOIN pairs q ON z.candidate_id = q.candidate_id GROUP BY z.candidate_id""",
)
def poi_density_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zones(spark, sf_dir).select("candidate_id", "lat", "lon")
    out = spatial.count_by_kind(z, points(spark, sf_dir), 0.5, ["commercial", "educational", "parks"])
    return out.select("candidate_id", "poi_commercial_500m", "poi_educational_500m", "poi_parks_500m")


@query(
    "flat_distance",
    "F10 J1",
    with_views(ZONES_SQL, POINTS_SQL)
    + f""",
anchor AS (SELECT district_id, min(point_id) AS point_id FROM points GROUP BY district_id),
ap AS (SELECT p.* FROM points p JOIN anchor a ON p.point_id = a.point_id)
SELECT z.candidate_id, ap.point_id AS anchor_point_id, round({dist_sql('z', 'ap')} * 1000, 4) AS dist_to_anchor_m
FROM zones z LEFT JOIN ap ON z.district_id = ap.district_id""",
)
def flat_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from every zone to its district's anchor point (smallest point id).

    One anchor per district: the anchor table is bounded by the number of
    districts and is pre-aggregated before the equi-join on district.
    """
    p = points(spark, sf_dir)
    anchor = p.groupBy("district_id").agg(F.min(F.struct("point_id", "lat", "lon")).alias("a")).select(
        "district_id", F.col("a.point_id").alias("anchor_point_id"), F.col("a.lat").alias("alat"),
        F.col("a.lon").alias("alon"))
    z = zones(spark, sf_dir).select("candidate_id", "district_id", "lat", "lon")
    j = z.join(anchor, "district_id", "left")
    return j.select("candidate_id", "anchor_point_id",
                    F.round(flat_km("lat", "lon", "alat", "alon") * 1000.0, 4).alias("dist_to_anchor_m"))


@query(
    "conform_zones",
    "P2 P3 P4 P5 P8 P12",
    with_views(ZONES_SQL)
    + """
SELECT candidate_id, district_id, lat AS latitude, lon AS longitude,
       coalesce(CAST(NULL AS DOUBLE), lat) AS centroid_lat, coalesce(CAST(NULL AS DOUBLE), lon) AS centroid_lon,
       population_density, CAST(NULL AS BIGINT) AS num_households, nse_ab_pct,
       CAST(NULL AS DOUBLE) AS nse_c_pct, CAST(NULL AS DOUBLE) AS urbanization_rate,
       dist_nearest_road_m, walkability_score, CAST(land_use_encoded AS BIGINT) AS land_use_encoded, waste_per_capita_kg,
       CAST(NULL AS DOUBLE) AS coverage_gap_index
FROM zones""",
)
def conform_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cast to the contract, add missing contract columns as null, canonical order."""
    z = zones(spark, sf_dir).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    z = z.withColumns({"centroid_lat": F.lit(None).cast("double"), "centroid_lon": F.lit(None).cast("double")})
    z = z.withColumns({"centroid_lat": F.coalesce("centroid_lat", "latitude"),
                       "centroid_lon": F.coalesce("centroid_lon", "longitude")})
    z = canonical_order(add_missing(cast_contract(z)), ["candidate_id", "district_id", "latitude", "longitude",
                                                         "centroid_lat", "centroid_lon"] + ALL_FEATURES)
    # Ordered, de-duplicated, existing columns; P12: numeric ones, read from the schema
    keep = unique_existing(z, ["candidate_id", "district_id", "latitude", "longitude", "centroid_lat",
                               "centroid_lon", "population_density", "num_households", "nse_ab_pct", "nse_c_pct",
                               "urbanization_rate", "dist_nearest_road_m", "walkability_score", "land_use_encoded",
                               "waste_per_capita_kg", "coverage_gap_index", "latitude"])
    numeric = set(numeric_columns(z))
    return z.select(*[c for c in keep if c in numeric])


@query(
    "derive_features",
    "F2 F3 F4 F5 F6 F7 F16",
    with_views(ZONE_FEATURES_SQL)
    + """
SELECT candidate_id, round(accessibility_composite, 6) AS accessibility_composite, nse_high_ratio,
       recycling_deficit, coverage_gap_index, CAST(land_use_encoded AS DOUBLE) AS poi_parks_500m
FROM (SELECT *, 0.6 * walkability_score + 0.4 * (1 - least(greatest(dist_nearest_road_m / 300, 0.0), 1.0)) AS accessibility_composite,
             nse_ab_pct AS nse_high_ratio,
             CAST(coalesce(dist_nearest_recycling_m >= 500, false) AS INTEGER) AS recycling_deficit,
             CAST(CAST(coalesce(dist_nearest_recycling_m >= 500, false) AS INTEGER) AS DOUBLE) AS coverage_gap_index
      FROM zf) t""",
)
def derive_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived features refreshed; ``has_park_300m`` stands in for parks."""
    z = zone_table(spark, sf_dir).withColumn("has_park_300m", F.col("land_use_encoded"))
    d = fx.with_derived(z, refresh=True)
    return d.select("candidate_id", F.round("accessibility_composite", 6).alias("accessibility_composite"),
                    "nse_high_ratio", "recycling_deficit", "coverage_gap_index", "poi_parks_500m")


@query(
    "derive_missing",
    "F1 F3 F5 F6 F7",
    with_views(ZONE_FEATURES_SQL)
    + """
SELECT candidate_id, round(0.6 * walkability_score + 0.4 * (1 - least(greatest(dist_nearest_road_m / 300, 0.0), 1.0)), 6) AS accessibility_composite,
       CAST(0.5 AS DOUBLE) AS nse_high_ratio, CAST(coalesce(dist_nearest_recycling_m >= 500, false) AS INTEGER) AS recycling_deficit,
       CAST(coalesce(dist_nearest_recycling_m >= 500, false) AS INTEGER)::DOUBLE AS coverage_gap_index, CAST(land_use_encoded AS DOUBLE) AS poi_parks_500m
FROM zf""",
)
def derive_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that lacks four derived features and has a fifth, which stays."""
    z = zone_table_stored(spark, sf_dir).withColumns({"has_park_300m": F.col("land_use_encoded"), "nse_high_ratio": F.lit(0.5)})
    d = fx.with_derived(z, refresh=False)
    return d.select("candidate_id", F.round("accessibility_composite", 6).alias("accessibility_composite"),
                    "nse_high_ratio", "recycling_deficit", "coverage_gap_index", "poi_parks_500m")


@query(
    "potential_index",
    "F8 F9 J1",
    with_views(ZONES_SQL, DISTRICTS_SQL)
    + """
SELECT z.candidate_id, d.district_name,
       round(z.population_density * d.gpc_kg_per_capita_day * d.pct_recyclable / 100, 6) AS recycling_potential_index,
       round(d.pct_recyclable / 100, 6) AS recyclable_rate
FROM zones z LEFT JOIN districts d ON z.district_id = d.district_id""",
)
def potential_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zones(spark, sf_dir).select("candidate_id", "district_id", "population_density")
    j = z.join(bounded_broadcast(districts(spark, sf_dir)), "district_id", "left")
    return j.select(
        "candidate_id", "district_name",
        F.round(fx.potential_index("population_density", "gpc_kg_per_capita_day", "pct_recyclable"), 6)
        .alias("recycling_potential_index"),
        F.round(fx.pct_to_rate("pct_recyclable"), 6).alias("recyclable_rate"),
    )
