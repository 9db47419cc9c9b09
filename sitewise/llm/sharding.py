"""Sharding by fixed virtual slots.

Every record belongs to one of some thousands of slots by a hash of its doc_id, for
good.  Which shard holds a slot is a map of as many rows as there are slots, stored in
versions: version 0 deals the slots round robin, and each later version is an edit
of the one before.  ``rebalanced`` evens out the bytes: a shard keeps its largest slots
up to the mean, what is over goes, largest first, to the shard with the fewest bytes.
``grown`` adds a shard, into which alone slots move.

A record's place in its shard is the number of records in the shard's earlier slots
plus its place in the slot, so that no task sorts more than a slot.

The size of a record is the UTF-8 bytes of its text (0 if null) plus 8.  Records without
doc_id are hashed by their text.  Repeated rows share a slot and take places of their own.
An empty table gives no rows.  The caller's other columns travel in the struct ``row``,
whatever their names, where they are asked for.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sql import CRC_STEP, crc32
from .store import shared_dir

SLOTS = 8192
OVERHEAD = 8


def slot_of(doc_id: Column, text: Column, slots: int) -> Column:
    """The first eight hex digits of a digest of the doc_id (or text), modulo slots."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit(":"), text), F.lit(":")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def measured(docs: DataFrame, slots: int = SLOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot), and the named columns as a struct ``row``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot"), *kept)


def weights(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and records of every slot: two lists of ``slots`` numbers, whatever the table's size."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], count[r.virtual_slot] = r["size"], r.n
    return size, count


def round_robin(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: the shard of each slot."""
    return [slot % shards for slot in range(slots)]


def largest_first(slots: list[int], size: list[int]) -> list[int]:
    return sorted(slots, key=lambda s: (-size[s], s))


def rebalanced(shard_of: list[int], size: list[int], shards: int) -> list[int]:
    """An edit of the map that evens out the bytes of the shards."""
    mean = sum(size) / shards
    load, over, out = [0] * shards, [], list(shard_of)
    kept_so_far = [0] * shards
    for slot in largest_first(list(range(len(size))), size):
        shard = shard_of[slot]
        kept_so_far[shard] += size[slot]
        if kept_so_far[shard] > mean:
            over.append(slot)
        else:
            load[shard] += size[slot]
    heap = [(n, shard) for shard, n in enumerate(load)]
    heapq.heapify(heap)
    for slot in over:
        n, shard = heap[0]
        out[slot] = shard
        heapq.heapreplace(heap, (n + size[slot], shard))
    return out


def grown(shard_of: list[int], size: list[int], shards: int) -> list[int]:
    """An edit of a map of ``shards`` shards that moves slots into one more shard, and nowhere else."""
    mean = sum(size) / (shards + 1)
    load, out, taken = [0] * shards, list(shard_of), 0
    for slot, shard in enumerate(shard_of):
        load[shard] += size[slot]
    for slot in largest_first(list(range(len(size))), size):
        shard = shard_of[slot]
        if load[shard] - size[slot] >= mean and taken + size[slot] <= mean:
            out[slot], taken = shards, taken + size[slot]
            load[shard] -= size[slot]
    return out


class SlotMap:
    """Versions of a slot-to-shard map, each a Parquet table (virtual_slot, shard) in the shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"

    def put(self, shard_of: list[int], version: int) -> DataFrame:
        table = self.spark.createDataFrame(list(enumerate(shard_of)), "virtual_slot int, shard int")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/version={version}")
        return self.get(version)

    def get(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.folder}/version={version}").withColumn("map_version", F.lit(version))


def placed(rows: DataFrame, slot_map: DataFrame, count: list[int]) -> DataFrame:
    """The measured rows with shard, slot (their place in it, gapless from 0) and map_version."""
    spark = rows.sparkSession
    counts = spark.createDataFrame(list(enumerate(count)), "virtual_slot int, n long")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    layout = slot_map.join(F.broadcast(counts), "virtual_slot")
    layout = layout.select("virtual_slot", "shard", "map_version", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(layout), "virtual_slot").withColumn("slot", (F.col("first") + F.col("place")).cast("long")).drop("first", "place")


def sharded(docs: DataFrame, shards: int, slots: int = SLOTS, keep: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """Records in shards of near equal bytes: doc_id, size, text_crc32, virtual_slot, shard, slot, map_version, law and grown_shard."""
    rows = measured(docs, slots, keep)
    size, count = weights(rows, slots)
    versions = SlotMap(docs.sparkSession, folder)
    first = round_robin(shards, slots)
    versions.put(first, 0)
    even = versions.put(rebalanced(first, size, shards), 1)
    return placed(rows, even, count).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


ORACLE = f"""
    WITH RECURSIVE {CRC_STEP},
    rows AS (
        SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {crc32("coalesce(text, '')")} AS crc,
               (('0x' || substr(md5(coalesce(doc_id::VARCHAR, ':' || text, ':')), 1, 8))::BIGINT % 8192)::INTEGER AS slot
        FROM documents, step),
    slots AS (SELECT slot, slot % 24 AS shard, sum(size)::BIGINT AS size FROM rows GROUP BY slot),
    judged AS (
        SELECT *, sum(size) OVER (PARTITION BY shard ORDER BY size DESC, slot) > sum(size) OVER () / 24.0::DOUBLE AS over FROM slots),
    loads AS (
        SELECT list(n ORDER BY shard) AS load FROM (
            SELECT s AS shard, coalesce(sum(size) FILTER (NOT over), 0)::BIGINT AS n
            FROM (SELECT unnest(range(24)) AS s) LEFT JOIN judged ON shard = s GROUP BY s)),
    queue AS (SELECT slot, size, row_number() OVER (ORDER BY size DESC, slot) AS i FROM judged WHERE over),
    moved(i, slot, shard, load) AS (
        SELECT 0::BIGINT, NULL::INTEGER, NULL::INTEGER, load FROM loads
        UNION ALL
        SELECT q.i, q.slot, (least - 1)::INTEGER, list_transform(load, lambda n, j: CASE WHEN j = least THEN n + q.size ELSE n END)
        FROM (SELECT i, load, list_position(load, list_min(load)) AS least FROM moved) m JOIN queue q ON q.i = m.i + 1),
    map AS (SELECT slot, shard FROM judged WHERE NOT over UNION ALL SELECT slot, shard FROM moved WHERE i > 0)
    SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, slot AS virtual_slot, shard::INTEGER AS shard, 1 AS map_version, 'bytes' AS law,
           NULL::INTEGER AS grown_shard, row_number() OVER (PARTITION BY shard ORDER BY slot, doc_id, size, crc) - 1 AS slot
    FROM rows JOIN map USING (slot)"""
