"""Points that arrive later (§2.12): radius counts and nearest distances kept up to date by a stream.

The state is a table in the shared folder with the sums of each micro-batch by zone: how many
of its points lie within the radius, and the least distance among them.  A batch's points
are written once; zones then meet them like any table of points (:mod:`spatial`): copies
in 3 x 3 cells or, where they crowd, a pyramid of pre-summed cells, so that a zone's work follows
the rim of its circle and not the points in it.  Counts add up and minima don't depend on the
order of points, so any division into batches gives what the batch join gives.  The
stream's checkpoint knows which files are done; a retried batch overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial
from ..session import cached


def follow(spark: SparkSession, points_dir: str, schema, zones: DataFrame, r_km: float, key: str, out_dir: str, checkpoint_dir: str,  # noqa: ANN001
           files_per_batch: int = 64) -> None:
    """Bring the counts up to date with all files that have come to ``points_dir``.

    Points without coordinates count nowhere.  Call it again with the same folders when there are
    new files: it goes on from the checkpointed state.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(points_dir)
    here = stream.where("lat is not null and lon is not null").select(F.lit(0).alias("point_id"), "lat", "lon")
    fixed = zones.select(F.col(key).alias("_key"), "lat", "lon")

    def keep(arrived: DataFrame, batch: int) -> None:
        given = f"{out_dir}-points/batch={batch}"
        arrived.write.mode("overwrite").parquet(given)
        points = spark.read.schema(arrived.schema).parquet(given)
        counted = cached(spatial.count_within(fixed, points, r_km, out="n").where("n > 0"))
        near = spatial.nearest(counted, points, dist_col="km", id_col=None)
        sums = near.groupBy("_key").agg(F.sum("n").alias("n"), F.min("km").alias("km"))
        sums.write.mode("overwrite").parquet(f"{out_dir}/batch={batch}")

    query = here.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()


def counts(spark: SparkSession, out_dir: str, zones: DataFrame, key: str, out: str = "n_within") -> DataFrame:
    """The zones with their count so far (0 if nothing came near) and the least distance (null then)."""
    kind = zones.schema[key].dataType.simpleString()
    batches = spark.read.schema(f"_key {kind}, n bigint, km double, batch int").option("basePath", out_dir).parquet(f"{out_dir}/batch=*")
    so_far = batches.groupBy("_key").agg(F.sum("n").alias("n"), F.min("km").alias("km"))
    found = zones.alias("z").join(so_far.alias("s"), F.col(f"z.`{key}`") == F.col("s._key"), "left")
    return found.select(*[F.col(f"z.`{c}`") for c in zones.columns], F.coalesce("s.n", F.lit(0)).alias(out), F.col("s.km").alias("nearest_km"))
