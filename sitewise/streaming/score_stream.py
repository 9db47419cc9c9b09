"""Structured Streaming scoring (§2.12): the stateless zone transforms and the
fitted model applied to a file stream, instead of a request/response path.

Nothing here keeps state: derived features, scoring and the flag are
row-wise, so the batch functions are reused unchanged on a streaming frame.
``availableNow`` processes what is there and stops, which makes the stream
testable and lets a scheduler run it as an incremental batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.booster import BoostedModel


def score_stream(spark: SparkSession, source_dir: str, schema, model: BoostedModel, threshold: float,  # noqa: ANN001
                 sink_dir: str, checkpoint_dir: str, fmt: str = "parquet") -> None:
    """Read new files of zone rows, score them, append (zone_id, score, flag)."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    scored = model.transform(stream)
    out = scored.select(F.col("candidate_id").cast("string").alias("zone_id"),
                        F.round("prob", 4).alias("suitability_score"),
                        (F.col("prob") >= F.lit(threshold)).alias("is_recommended"))
    q = (out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def read_sink(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir)
