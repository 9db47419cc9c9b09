"""Driver tables and the zone / point views derived from them.

Zones come from ``customer`` and points from ``supplier`` by integer
arithmetic (FIXTURES.md §3), so the same rows can be produced by Spark and by
an independent SQL engine.  Every function reads only the columns it needs,
which the parquet scan turns into a pruned ``ReadSchema``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# fixed values: the POI kinds a point cycles through (by point id mod 3)
POINT_KINDS = ["commercial", "educational", "parks"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coord(key: Column, mult: int, mod: int, origin: float) -> Column:
    return F.lit(origin).cast("double") + (key * F.lit(mult)) % F.lit(mod) / F.lit(100000)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate zones, one per customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("candidate_id"),
        F.col("c_nationkey").cast("int").alias("district_id"),
        F.col("c_name").alias("address"),
        _coord(k, 7907, 10007, -12.2).alias("lat"),
        _coord(k, 6101, 10009, -77.1).alias("lon"),
        (F.lit(5000) + (k * 31) % 17000).cast("double").alias("population_density"),
        (((k * 17) % 91 + 5) / 100).alias("nse_ab_pct"),
        F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise((k * 13) % 101 / 100).alias("walkability_score"),
        ((k * 37) % 401).cast("double").alias("dist_nearest_road_m"),
        ((F.lit(20) + (k * 11) % 131) / 100).alias("waste_per_capita_kg"),
        ((k * 7) % 4).cast("int").alias("land_use_encoded"),
        ((k * 7919) % 1009 / 1009).alias("u"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing recycling points / POIs, one per supplier."""
    k = F.col("s_suppkey")
    kinds = F.array(*[F.lit(x) for x in POINT_KINDS])
    return table(spark, sf_dir, "supplier").select(
        k.alias("point_id"),
        F.col("s_nationkey").cast("int").alias("district_id"),
        F.col("s_name").alias("name"),
        _coord(k, 7919, 10007, -12.2).alias("lat"),
        _coord(k, 6007, 10009, -77.1).alias("lon"),
        F.element_at(kinds, (k % 3 + 1).cast("int")).alias("kind"),
    )


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District dimension: nation joined to region (25 rows, broadcast-sized)."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left").select(
        F.col("n_nationkey").alias("district_id"),
        F.col("n_name").alias("district_name"),
        F.col("r_name").alias("region_name"),
        (F.lit(8000) + F.col("n_nationkey") * 500).cast("double").alias("district_density"),
        ((F.col("n_nationkey") % 5).cast("double") * F.lit(0.1) + F.lit(0.6)).alias("gpc_kg_per_capita_day"),
        (F.lit(25.0) + F.col("n_nationkey") % 7).cast("double").alias("pct_recyclable"),
    )


# SQL twins of the views above, used by the oracle queries.
ZONES_SQL = """
zones AS (
  SELECT c_custkey AS candidate_id,
         CAST(c_nationkey AS INTEGER) AS district_id,
         c_name AS address,
         CAST(-12.2 AS DOUBLE) + ((c_custkey * 7907) % 10007) / 100000 AS lat,
         CAST(-77.1 AS DOUBLE) + ((c_custkey * 6101) % 10009) / 100000 AS lon,
         CAST(5000 + (c_custkey * 31) % 17000 AS DOUBLE) AS population_density,
         ((c_custkey * 17) % 91 + 5) / 100 AS nse_ab_pct,
         CASE WHEN c_custkey % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE ((c_custkey * 13) % 101) / 100 END AS walkability_score,
         CAST((c_custkey * 37) % 401 AS DOUBLE) AS dist_nearest_road_m,
         (20 + (c_custkey * 11) % 131) / 100 AS waste_per_capita_kg,
         CAST((c_custkey * 7) % 4 AS INTEGER) AS land_use_encoded,
         ((c_custkey * 7919) % 1009) / 1009 AS u
  FROM customer)"""

POINTS_SQL = """
points AS (
  SELECT s_suppkey AS point_id,
         CAST(s_nationkey AS INTEGER) AS district_id,
         s_name AS name,
         CAST(-12.2 AS DOUBLE) + ((s_suppkey * 7919) % 10007) / 100000 AS lat,
         CAST(-77.1 AS DOUBLE) + ((s_suppkey * 6007) % 10009) / 100000 AS lon,
         CASE s_suppkey % 3 WHEN 0 THEN 'commercial' WHEN 1 THEN 'educational' ELSE 'parks' END AS kind
  FROM supplier)"""

DISTRICTS_SQL = """
districts AS (
  SELECT n_nationkey AS district_id, n_name AS district_name, r_name AS region_name,
         CAST(8000 + n_nationkey * 500 AS DOUBLE) AS district_density,
         CAST(n_nationkey % 5 AS DOUBLE) * 0.1 + 0.6 AS gpc_kg_per_capita_day,
         CAST(25 + n_nationkey % 7 AS DOUBLE) AS pct_recyclable
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)"""


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views)
