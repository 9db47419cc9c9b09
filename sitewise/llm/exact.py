"""Exact dedup as a stateful stream over digests, with full bytes compared on hits.

The stream keeps one state entry per digest, in RocksDB on the executors' disks and
checkpointed to the shared folder, and never expires it: the digest, the smallest
doc_id seen (the stable identifier), the file that holds it (the content locator) and
the number of rows.  Rows are summed up by digest before they are shuffled, so a group
of copies reaches its state as one row a task.  Each micro-batch hands on the entries
it changed; a retried batch overwrites its own output.

The bytes of every digest with more than one row are then compared, and texts that
only share a digest are told apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved, shared_dir

#: state on the executors' disks, without the megabytes that each small store would reserve in advance
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Each run of 0x20 and 0x09-0x0D as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keepers(spark: SparkSession, path: str, schema, digest: Callable[[Column], Column] = sha256, files: int | None = None) -> DataFrame:  # noqa: ANN001
    """(digest, keep_id, locator, n) of a Parquet table, read as a stream of its files.

    files: files a micro-batch takes (all that are there if None).
    """
    reader = spark.readStream.schema(schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    # as a pattern, since a stream takes a plain path for a folder and the table may be one file
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{folder}/{{{name}}}")
    state = stream.select(digest(normalised(F.col("text"))).alias("digest"), "doc_id", F.col("_metadata.file_path").alias("file")).groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"), F.min_by("file", "doc_id").alias("locator"), F.count("*").alias("n"))
    out, marks = (f"{shared_dir(spark)}/exact-{x}-{uuid.uuid4().hex}" for x in ("out", "stream"))

    def hand_on(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(hand_on).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    kinds = state.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", batch int"
    batches = spark.read.schema(kinds).option("basePath", out).parquet(f"{out}/batch=*") if query.lastProgress else spark.createDataFrame([], kinds)
    latest = F.max_by(F.struct("keep_id", "locator", "n"), "batch").alias("last")
    return batches.groupBy("digest").agg(latest).select("digest", "last.*")


def duplicates(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of the table.

    Rows are equal if their normalised texts have the same bytes; a null text counts as
    empty.  keep_id is the smallest doc_id of a group (null only if all are null); of
    repeated rows with that id one is kept.  An empty table gives no rows; columns other
    than doc_id and text are not read.
    """
    docs = spark.read.parquet(path).select("doc_id", "text")
    found = keepers(spark, path, docs.schema, digest, files)
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "norm", sha256(F.col("norm")).alias("text_sha256"), digest(F.col("norm")).alias("digest"))
    members = saved(rows.select("doc_id", "text_sha256", "digest").join(found.drop("locator"), "digest"), "exact-members")

    hits = members.filter("n > 1").select("doc_id", "digest").distinct()
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.digest") == F.col("r.digest"))
    compared = rows.alias("l").join(hits.alias("r"), same, "left_semi")
    texts = compared.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    marked = texts.select("digest", sha256(F.col("norm")).alias("text_sha256"), "norm", "keep_id", "n")
    shared = saved(marked.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "exact-collisions")

    groups = members.select("doc_id", "text_sha256", "digest", "keep_id", "n")
    if not shared.isEmpty():
        apart = marked.join(shared, "digest", "left_semi")
        own = compared.join(shared, "digest", "left_semi").select("doc_id", "text_sha256", "digest", "norm")
        own = own.join(apart.select("digest", "norm", "keep_id", "n"), ["digest", "norm"]).select(*groups.columns)
        groups = groups.join(shared, "digest", "left_anti").select(*groups.columns).unionByName(own)
    once = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("digest")) == 1
    return groups.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & once).alias("kept"), "text_sha256")
