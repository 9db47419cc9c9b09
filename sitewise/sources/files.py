"""File sources and sinks."""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ZONE


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV with an explicit schema (trap 7); Latin-1 via ``encoding``."""
    r = spark.read.option("header", True).option("encoding", encoding).option("multiLine", False)
    r = r.option("quote", '"').option("escape", '"')
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """CSV sink (one folder of part files, header)."""
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm  # Hadoop FileSystem lookup, works for any cluster file system
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)


def resolve_source(spark: SparkSession, *candidates: str) -> str:
    """S3: the first existing path (materialised before raw); error if none."""
    for c in candidates:
        if _exists(spark, c):
            return c
    raise FileNotFoundError(f"no source found among {list(candidates)}")


def write_summary(spark: SparkSession, summary: DataFrame, path: str) -> None:
    """One-row summary written as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def append_run(spark: SparkSession, path: str, record: dict) -> None:
    """Append a run record (metrics + threshold) to a runs table."""
    row = {"run_at": _dt.datetime.now(_dt.timezone.utc).isoformat(), "record": json.dumps(record, sort_keys=True)}
    spark.createDataFrame([row], "run_at string, record string").write.mode("append").parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The latest record via ``max_by`` (no sort of the whole table)."""
    runs = spark.read.parquet(path)
    return runs.agg(F.max_by("record", "run_at").alias("record"), F.max("run_at").alias("run_at"))


def records_to_zones(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Request records → zone table; missing/None fields become nulls."""
    rows = [{f.name: r.get(f.name) for f in ZONE.fields} for r in records]
    return spark.createDataFrame(rows, ZONE)


def json_records_to_zones(df_json: DataFrame, col: str = "value") -> DataFrame:
    """S8 at scale: a column of JSON records parsed with the explicit schema."""
    return df_json.select(F.from_json(F.col(col), ZONE).alias("z")).select("z.*")


def head_records(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows in a total order, as JSON records."""
    return df.orderBy(*order).limit(n).select(F.to_json(F.struct("*")).alias("record"))


def boundary_edges(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Geocoder-style places with a GeoJSON Polygon or MultiPolygon → edge table.

    lines: one place a line, which Spark reads in splits; else an array of places a file.
    Output (name, part, ring, seq, x1, y1, x2, y2) in degrees (x = lon, y = lat); ring 0
    of a part is its outline, the others are holes.  Rings that aren't closed are closed;
    other geometries (points, lines) have no edges.
    """
    # coordinates differ by geometry type: they are read as raw JSON text, and only
    # areas are parsed, a Polygon as the one part of a MultiPolygon
    schema = "name string, geojson struct<type string, coordinates string>"
    raw = spark.read.option("multiLine", not lines).schema(schema).json(path)
    kind, text = F.col("geojson.type"), F.col("geojson.coordinates")
    parts = F.when(kind == "MultiPolygon", text).when(kind == "Polygon", F.concat(F.lit("["), text, F.lit("]")))
    found = raw.select("name", F.posexplode(F.from_json(parts, "array<array<array<array<double>>>>")).alias("part", "rings"))
    found = found.select("name", "part", F.posexplode("rings").alias("ring", "c"))
    closed = F.when(F.element_at("c", 1) == F.element_at("c", -1), F.col("c")).otherwise(F.concat("c", F.slice("c", 1, 1)))
    ends = F.zip_with(closed, F.slice(closed, 2, F.size(closed)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = found.select("name", "part", "ring", F.posexplode(ends).alias("seq", "e")).where("e.b is not null")
    at = lambda end, i: F.col(f"e.{end}")[i].cast("double")
    return found.select("name", "part", "ring", "seq", at("a", 0).alias("x1"), at("a", 1).alias("y1"), at("b", 0).alias("x2"), at("b", 1).alias("y2"))
