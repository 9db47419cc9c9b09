"""Stage 3 queries: dimension lookups, labels, sampling, dataset assembly."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets as ds
from ..operators import spatial
from ..operators.joins import bounded_broadcast
from ..schema import _INT_FEATURES, ALL_FEATURES, LOCATION_COLUMNS, TRACE_COLUMNS
from ..session import cached, ensure_checkpoint_dir
from ..sources import files
from ..sources.tables import DISTRICTS_SQL, POINTS_SQL, ZONES_SQL, districts, points, with_views, zones
from .registry import dist_sql, query
from .zones_q import ZONE_FEATURES_SQL, scored_zones

#: contract features of the real dataset that the given tables have or that follow from them
REAL_GIVEN = {"population_density", "nse_ab_pct", "dist_nearest_road_m", "walkability_score", "waste_per_capita_kg", "land_use_encoded",
              "accessibility_composite", "nse_high_ratio"}


@query(
    "district_lookup",
    "J1 J2",
    with_views(ZONES_SQL, DISTRICTS_SQL)
    + """,
zd AS (SELECT z.candidate_id, d.district_name, d.district_density
       FROM zones z LEFT JOIN districts d ON z.district_id = d.district_id)
SELECT zd.candidate_id, zd.district_name, zd.district_density, r.district_name AS recovered_name
FROM zd LEFT JOIN districts r ON zd.district_density = r.district_density""",
)
def district_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants by district (left, unmatched → null) and the reverse lookup on a double."""
    d = bounded_broadcast(districts(spark, sf_dir))
    z = zones(spark, sf_dir).select("candidate_id", "district_id")
    zd = z.join(d.select("district_id", "district_name", "district_density"), "district_id", "left")
    back = d.select("district_density", F.col("district_name").alias("recovered_name"))
    return zd.join(back, "district_density", "left").select("candidate_id", "district_name", "district_density",
                                                             "recovered_name")


@query(
    "assign_district",
    "J8",
    with_views(ZONES_SQL)
    + """
SELECT CASE WHEN lon < -77.055 THEN 'Magdalena del Mar' ELSE 'Miraflores' END AS district,
       CAST(count(*) AS BIGINT) AS n_zones
FROM zones GROUP BY 1""",
)
def assign_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zones(spark, sf_dir).withColumn("district", ds.assign_district("lon"))
    return z.groupBy("district").agg(F.count(F.lit(1)).alias("n_zones"))


LABELLED_SQL = with_views(ZONES_SQL, POINTS_SQL) + f""",
lab AS (SELECT z.*, CAST(EXISTS (SELECT 1 FROM points p WHERE {dist_sql('z', 'p')} <= CAST(0.3 AS DOUBLE)) AS INTEGER)
               AS is_suitable FROM zones z),
neg AS (SELECT * FROM lab WHERE is_suitable = 0 ORDER BY {ds.hash_order_sql('candidate_id')} LIMIT 40),
bal AS (SELECT candidate_id, is_suitable, lat, lon, lat AS centroid_lat, lon AS centroid_lon FROM lab WHERE is_suitable = 1
        UNION ALL
        SELECT candidate_id, is_suitable, lat, lon, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM neg)"""


def labelled_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zones(spark, sf_dir).select("candidate_id", "district_id", "lat", "lon")
    return spatial.exists_within(z, points(spark, sf_dir), 0.3, out="is_suitable", inclusive=True)


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.balanced_set(labelled_zones(spark, sf_dir), "is_suitable", "candidate_id")


@query(
    "balanced_training_set",
    "U1 U2 U3 U4 P6 P7",
    LABELLED_SQL + """
SELECT candidate_id AS zone_key, is_suitable AS is_optimal, lat AS latitude, lon AS longitude, centroid_lat
FROM bal""",
)
def balanced_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balanced(spark, sf_dir)
    b = b.withColumnsRenamed({"candidate_id": "zone_key", "is_suitable": "is_optimal", "lat": "latitude",
                              "lon": "longitude"})
    return b.drop("district_id", "centroid_lon")


@query(
    "real_candidates",
    "F1 P4 P5 P8 P9 P10 P13 P14 P15 P16",
    LABELLED_SQL + f""",
r AS (SELECT *, row_number() OVER (ORDER BY 1 - is_suitable, candidate_id) AS i, coalesce(centroid_lat, lat) AS c_lat,
             coalesce(centroid_lon, lon) AS c_lon FROM bal)
SELECT printf('{ds.REAL_ID_FORMAT}', i) AS candidate_id, '{ds.REAL_DATASET_VERSION}' AS dataset_version, '{ds.LABEL_VERSION}' AS label_version,
       '{ds.STATUS_UNKNOWN}' AS label_status, '' AS is_suitable,
       CASE WHEN coalesce(r.is_suitable, 0) = 1 THEN '{ds.ORIGIN_LEGACY_POSITIVE}' ELSE '{ds.ORIGIN_LEGACY_OTHER}' END AS candidate_origin,
       'balanced_training_set' AS source_dataset, '{ds.REAL_EVIDENCE}' AS evidence_summary, '{ds.REAL_REASON}' AS label_reason,
       '{ds.REAL_NOTES}' AS review_notes, z.district_id, n.n_name AS district, r.lat AS latitude, r.lon AS longitude,
       c_lat AS centroid_lat, c_lon AS centroid_lon,
       CASE WHEN c_lat IS NOT NULL AND c_lon IS NOT NULL THEN '{ds.GEOMETRY_OK}' ELSE '{ds.GEOMETRY_MISSING}' END AS geometry_quality,
       z.population_density, z.nse_ab_pct, z.dist_nearest_road_m, z.walkability_score, z.waste_per_capita_kg, z.land_use_encoded,
       {", ".join(f"CAST(NULL AS {'BIGINT' if f in _INT_FEATURES else 'DOUBLE'}) AS {f}" for f in ALL_FEATURES if f not in REAL_GIVEN)},
       round(0.6 * z.walkability_score + 0.4 * (1 - least(greatest(z.dist_nearest_road_m / 300, 0.0), 1.0)), 9) AS accessibility_composite,
       z.nse_ab_pct AS nse_high_ratio, r.candidate_id AS zone_key, n.n_name AS district_name, r.is_suitable AS is_optimal_legacy
FROM r JOIN zones z ON z.candidate_id = r.candidate_id LEFT JOIN nation n ON n.n_nationkey = z.district_id""",
)
def real_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole auditable dataset: trace, location and contract columns."""
    rc = _real(spark, sf_dir)
    return rc.withColumn("accessibility_composite", F.round("accessibility_composite", 9))


def _real(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balanced(spark, sf_dir).withColumnsRenamed(
        {"candidate_id": "zone_key", "is_suitable": "is_optimal", "lat": "latitude", "lon": "longitude"}).drop("district_id")
    given = zones(spark, sf_dir).select(F.col("candidate_id").alias("zone_key"), "district_id", "population_density", "nse_ab_pct",
                                        "dist_nearest_road_m", "walkability_score", "waste_per_capita_kg", "land_use_encoded")
    names = bounded_broadcast(districts(spark, sf_dir).select("district_id", "district_name"))
    return ds.real_candidates(b.join(given, "zone_key").join(names, "district_id", "left"))


@query(
    "real_summary",
    "S5 A1 A2",
    LABELLED_SQL + f"""
SELECT '{ds.REAL_DATASET_VERSION}' AS dataset_version, CAST(count(*) AS BIGINT) AS rows, CAST({len(TRACE_COLUMNS + LOCATION_COLUMNS + ALL_FEATURES) + 3} AS BIGINT) AS columns,
       CAST(count(*) FILTER (WHERE coalesce(centroid_lat, lat) IS NOT NULL AND coalesce(centroid_lon, lon) IS NOT NULL) AS BIGINT) AS with_centroid,
       false AS training_allowed, '{ds.STATUS_UNKNOWN}:' || count(*) AS label_status_counts,
       (SELECT string_agg(is_suitable || ':' || n, ',' ORDER BY CAST(is_suitable AS VARCHAR)) FROM (SELECT is_suitable, count(*) AS n FROM bal GROUP BY 1)) AS is_optimal_legacy_counts
FROM bal""",
)
def real_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the real dataset, written as its sidecar and read back."""
    real = cached(_real(spark, sf_dir))
    row = ds.real_summary(real).withColumns({f"{c}_counts": ds.count_text(real, c).scalar() for c in ("label_status", "is_optimal_legacy")})
    path = os.path.join(ensure_checkpoint_dir(spark), "io", f"summary-{uuid.uuid4().hex}")
    files.write_summary(spark, row, path)
    return spark.read.schema(row.schema).json(path)


SCORE_RATE = 0.35


@query(
    "quantile_label",
    "A20 D8 L2",
    with_views(ZONE_FEATURES_SQL)
    + """,
s AS (SELECT candidate_id, round(prob_optimal, 4) AS suitability_score FROM scored),
c AS (SELECT round(quantile_cont(suitability_score, 0.65), 9) AS cutoff FROM s)
SELECT candidate_id, CAST(coalesce(suitability_score >= cutoff, false) AS INTEGER) AS is_optimal,
       round(cutoff, 6) AS score_cutoff FROM s, c""",
)
def quantile_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_zones(spark, sf_dir, stored=True).select("candidate_id", "suitability_score")
    lab, cutoff = ds.quantile_label(s, "suitability_score", SCORE_RATE)
    return lab.select("candidate_id", "is_optimal", F.round(F.lit(cutoff).cast("double"), 6).alias("score_cutoff"))


@query(
    "bernoulli_label",
    "L3",
    with_views(ZONE_FEATURES_SQL)
    + """
SELECT candidate_id, CAST(coalesce(u < (prob_optimal - 0.7) / 0.3, false) AS INTEGER) AS is_optimal FROM scored""",
)
def bernoulli_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_zones(spark, sf_dir, stored=True).withColumn("_p", (F.col("prob_optimal") - 0.7) / 0.3)
    return s.select("candidate_id", ds.bernoulli_label("_p", "u").alias("is_optimal"))


@query(
    "labelled_dataset",
    "P5 P9 P13 P17",
    with_views(ZONE_FEATURES_SQL)
    + f""",
s AS (SELECT candidate_id AS zone_key, district_id, round(prob_optimal, 4) AS suitability_score FROM scored),
c AS (SELECT round(quantile_cont(suitability_score, 0.65), 9) AS cutoff FROM s)
SELECT printf('{ds.SIM_ID_FORMAT}', row_number() OVER (ORDER BY zone_key)) AS candidate_id, '{ds.SIMULATED_DATASET_VERSION}' AS dataset_version,
       '{ds.SIMULATED_LABEL_VERSION}' AS label_version, '{ds.STATUS_SIMULATED}' AS label_status,
       CAST(coalesce(suitability_score >= cutoff, false) AS INTEGER) AS is_suitable, '{ds.ORIGIN_SIMULATED}' AS candidate_origin,
       'scored_zones' AS source_dataset, district_id, row_number() OVER (ORDER BY zone_key) - 1 AS zone_id,
       CAST(coalesce(suitability_score >= cutoff, false) AS INTEGER) AS is_optimal, suitability_score, '{ds.SIMULATED_EVIDENCE}' AS evidence_summary,
       '{ds.SIMULATED_REASON}' AS label_reason, '{ds.SIMULATED_NOTES}' AS review_notes, zone_key
FROM s, c""",
)
def labelled_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_zones(spark, sf_dir, stored=True).select(F.col("candidate_id").alias("zone_key"), "district_id", "suitability_score")
    d, _ = ds.simulated_dataset(s, SCORE_RATE, "zone_key")
    return d


@query(
    "dataset_summary",
    "S5 A1 A2 A9",
    with_views(ZONE_FEATURES_SQL)
    + """,
s AS (SELECT candidate_id, district_id, round(prob_optimal, 4) AS suitability_score FROM scored),
c AS (SELECT round(quantile_cont(suitability_score, 0.65), 9) AS cutoff FROM s),
l AS (SELECT s.*, CAST(coalesce(suitability_score >= cutoff, false) AS INTEGER) AS is_optimal, cutoff FROM s, c)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT district_id) AS BIGINT) AS districts,
       CAST(count(*) FILTER (WHERE is_optimal = 1) AS BIGINT) AS n_pos,
       CAST(count(*) FILTER (WHERE is_optimal = 0) AS BIGINT) AS n_neg,
       CAST(0.35 AS DOUBLE) AS rate_requested, round(avg(is_optimal), 6) AS rate_observed, round(min(cutoff), 6) AS score_cutoff,
       true AS training_allowed
FROM l""",
)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_zones(spark, sf_dir, stored=True).select("candidate_id", "district_id", "suitability_score")
    lab, cutoff = ds.quantile_label(s, "suitability_score", SCORE_RATE)
    return lab.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("district_id").alias("districts"),
        F.count(F.when(F.col("is_optimal") == 1, 1)).alias("n_pos"),
        F.count(F.when(F.col("is_optimal") == 0, 1)).alias("n_neg"),
        F.lit(SCORE_RATE).alias("rate_requested"), F.round(F.avg("is_optimal"), 6).alias("rate_observed"),
        F.round(F.lit(cutoff).cast("double"), 6).alias("score_cutoff"), F.lit(True).alias("training_allowed"),
    )
