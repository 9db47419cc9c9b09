"""Spark session helpers.

Everything in the package is a plain ``DataFrame -> DataFrame`` function, so
the only session-level concerns are the configuration we want for local runs
and the shared checkpoint folder used to cut long lineages.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "sitewise") -> SparkSession:
    """A local session; its checkpoint folder is a fresh one unless already configured."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SITEWISE_DRIVER_MEMORY", "16g"))
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local master may lack the setting: it gets a fresh scratch folder.
    On a cluster the folder must be one that all executors share, so a missing
    setting is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sitewise-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    What follows depends on the rows alone: not on caches, nor on the physical
    partitions of a recomputed plan.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: rows that a task expands, for instance to the cells around each of them
ROWS_PER_TASK = 50_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows, over enough tasks that none expands more than ``ROWS_PER_TASK``.

    A small file is read by one task, which would do the whole of a broadcast join after it.
    """
    tasks = -(-rows // ROWS_PER_TASK)
    return df.repartition(tasks) if tasks > 1 else df


# Intermediate caches of the query being built (iterative rounds, value
# counts, range-partitioned rows).  A registered query releases the previous
# query's caches when it starts; a persisted frame keeps its lineage, so a
# late reader of an older result recomputes instead of failing.
_TRACKED: list[DataFrame] = []


def cached(df: DataFrame) -> DataFrame:
    """``persist`` and remember the frame for :func:`release_cached`."""
    df = df.persist()
    _TRACKED.append(df)
    return df


def release_cached() -> None:
    while _TRACKED:
        try:
            _TRACKED.pop().unpersist(blocking=False)
        except Exception:  # noqa: BLE001 - session already stopped
            pass
