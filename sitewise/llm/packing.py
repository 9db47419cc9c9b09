"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Each round sorts the unplaced pieces and the open gaps together by size, largest
first and gaps before pieces of their size.  The successor sweep gives a piece the
smallest gap that fits and is still free: gaps open a level, pieces close the
latest one, and a piece's partner is the gap before it on its level.  Levels come
from counts per size (at most twice the sequence length of rows) and from each
row's rank among its equals, which also settles conflicts.  Gaps are then updated
and the next round begins.

New sequences are opened only where any packing needs them: for the volume that
the open gaps can't take.  Small pieces travel in bundles of at most half the mean
useful gap, so that the number of rounds doesn't follow the number of pieces a
sequence can hold; a bundle without a partner is dissolved.

Rounds get smaller, but each takes the same few jobs.  Once the unplaced pieces and the
gaps that can take one are no more than a round's single task holds (``FINISH_ROWS``),
that task places all of them, the largest piece first, each in the smallest gap that fits.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .store import forget, saved, shared_dir

ROWS_PER_TASK = 20_000  # pieces and gaps that one window or task is meant to hold
FINISH_ROWS = 20_000    # pieces and gaps that are left at most when one task places the rest
PIECES_OUT = 20_000     # rows per Arrow batch
COMPILE = "spark.sql.codegen.wholeStage"
COMPILED_ROWS = 50_000  # rounds of as many pieces and gaps are worth compiling
STATE = "kind int, item long, length long, seq long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Encode every whole text, append ``end_id`` and cut at every ``capacity`` ids.

    Returns (doc_id, piece int, start, length, ids_crc32 longs).  A null or empty text
    is the one id ``end_id``; repeated rows give repeated pieces.
    """
    id_type = dict(docs.select("doc_id").dtypes)["doc_id"]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end, width = encoder(tokenizer), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple[int, int, int, int]] = []
            which: list[int] = []
            for k, data in enumerate(codec.encode(x.as_py() for x in batch.column(1))):
                data += end
                for i, a in enumerate(range(0, len(data), width)):
                    part = data[a : a + width]
                    rows.append((i, a // 4, len(part) // 4, zlib.crc32(part)))
                    which.append(k)
                if len(rows) >= PIECES_OUT:
                    yield table(ids, which, rows)
                    rows, which = [], []
            yield table(ids, which, rows)

    def table(ids: pa.Array, which: list[int], rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(which, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def _bundled(items: DataFrame, small: float, groups: int) -> DataFrame:
    """Add ``unit`` (what travels together), ``inside`` (offset in it) and ``size`` (of all of it).

    Pieces of at most ``small`` whose running sums begin in one stretch of that
    length make a unit of at most twice that length.
    """
    big = items.filter(F.col("length") > small).withColumns({"unit": F.col("item"), "inside": F.lit(0).cast("long"), "size": F.col("length")})
    few = items.filter(F.col("length") <= small).withColumn("g", F.pmod(F.xxhash64("item"), F.lit(groups)))
    running = Window.partitionBy("g").orderBy(F.desc("length"), "item").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("from", F.coalesce(F.sum("length").over(running), F.lit(0)))
    few = few.withColumn("stretch", F.floor(F.col("from") / F.lit(float(max(small, 1)))))
    unit = Window.partitionBy("g", "stretch")
    few = few.withColumns({"unit": F.min("item").over(unit), "inside": F.col("from") - F.min("from").over(unit), "size": F.sum("length").over(unit)})
    return big.unionByName(few.select(*big.columns))


def _sweep(units: DataFrame, gaps: DataFrame, tasks: int, salts: int) -> DataFrame:
    """Partners (unit, seq, size, gap): one unit per gap at most, each in the smallest free gap.

    Rows of one size are ranked in ``salts`` groups, so that no task holds them all.
    """
    both = units.select(F.lit(1).alias("closes"), F.col("unit").alias("row"), "size").unionByName(
        gaps.select(F.lit(0).alias("closes"), F.col("seq").alias("row"), F.col("gap").alias("size")))
    both = both.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    counts = both.groupBy("size", "closes", "salt").agg(F.count("*").alias("n")).coalesce(tasks)
    earlier = Window.partitionBy("size", "closes").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).coalesce(tasks)
    # two rows per possible length at most: how many gaps are open before the rows of a size
    step = F.when(F.col("closes") == 1, -F.col("n")).otherwise(F.col("n"))
    order = Window.orderBy(F.desc("size"), "closes")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = counts.groupBy("size", "closes").agg(F.sum("n").alias("n")).withColumn("sum", F.sum(step).over(so_far))
    sizes = sizes.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    sizes = sizes.select("size", "closes", F.coalesce(F.lag("depth").over(order), F.lit(0)).alias("open"))
    within = Window.partitionBy("size", "closes", "salt").orderBy("row")
    ranked = both.withColumn("k", F.row_number().over(within) - 1).join(counts, ["size", "closes", "salt"])
    ranked = ranked.join(F.broadcast(sizes), ["size", "closes"]).withColumn("rank", F.col("before") + F.col("k"))
    level = F.when(F.col("closes") == 1, F.col("open") - F.col("rank")).otherwise(F.col("open") + F.col("rank") + 1)
    levels = ranked.withColumn("level", level).filter("level > 0").select("level", "closes", "size", "row").coalesce(tasks)
    there = Window.partitionBy("level").orderBy(F.desc("size"), "closes")
    levels = levels.withColumns({"seq": F.lag("row").over(there), "gap": F.lag("size").over(there)})
    return levels.filter("closes = 1").select(F.col("row").alias("unit"), "size", "seq", "gap").coalesce(tasks)


def _finished(left: DataFrame, gaps: DataFrame, opened: int, capacity: int) -> DataFrame:
    """All of ``left`` (at most ``FINISH_ROWS`` with the gaps) placed, as rows of ``STATE``; new sequences count from ``opened``."""
    rest = left.select(F.lit(0).alias("kind"), F.col("item").alias("row"), "length").unionByName(
        gaps.select(F.lit(1).alias("kind"), F.col("seq").alias("row"), F.col("gap").alias("length")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["length", "row"], ascending=False)
        free: dict[int, list[int]] = {}  # size of a gap -> its sequences
        for seq, gap in rows.loc[rows["kind"] == 1, ["row", "length"]].itertuples(index=False):
            free.setdefault(gap, []).append(seq)
        sizes, unused, out = sorted(free), opened, []
        for item, length in rows.loc[rows["kind"] == 0, ["row", "length"]].itertuples(index=False):
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                seq = free[gap].pop()
                if not free[gap]:
                    del free[gap], sizes[at]
            else:
                seq, gap, unused = unused, capacity, unused + 1
            out.append((0, item, length, seq, capacity - gap))
            if gap > length:
                if gap - length not in free:
                    insort(sizes, gap - length)
                free.setdefault(gap - length, []).append(seq)
        yield pd.DataFrame(out, columns=["kind", "item", "length", "seq", "offset"])

    return rest.coalesce(1).mapInPandas(place, STATE)


@contextmanager
def _plain(spark: SparkSession, rows: int) -> Iterator[None]:
    """While a round has few rows, its plan is run as it is: compiling it takes longer and fills the driver."""
    before = spark.conf.get(COMPILE, None)
    if rows < COMPILED_ROWS:
        spark.conf.set(COMPILE, "false")
    try:
        yield
    finally:
        spark.conf.set(COMPILE, before) if before else spark.conf.unset(COMPILE)


def best_fit(spark: SparkSession, items: DataFrame, capacity: int) -> DataFrame:
    """Place items (item long unique, length long, 1 to capacity) into sequences.

    Returns (item, sequence_id, offset), every item once.  No items, no rows.  A round
    writes its pairs and then one table of items and gaps, which the next one reads.  Later
    rounds have few rows and run in as few tasks; the last one places what is left.
    """
    whole = items.filter(F.col("length") == capacity).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = items.filter(F.col("length") < capacity).select("item", "length")
    gaps = spark.range(0).select(F.col("id").alias("seq"), F.col("id").alias("gap"))
    opened, rounds, most = 0, [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"
    while True:
        both = left.select("length", F.lit(0).alias("kind")).unionByName(gaps.select(F.col("gap").alias("length"), F.lit(1).alias("kind")))
        found = both.groupBy("kind", "length").agg(F.count("*").alias("n")).collect()  # twice the capacity of rows at most
        sizes = {r["length"]: r["n"] for r in found if not r["kind"]}
        if not sizes:
            break
        free = {r["length"]: r["n"] for r in found if r["kind"] and r["length"] >= min(sizes)}
        volume, room, largest = sum(s * n for s, n in sizes.items()), sum(g * n for g, n in free.items()), max(free, default=0)
        misfit = sum(s * n for s, n in sizes.items() if s > largest)
        new = max(-(-max(0, volume - room) // capacity), -(-misfit // capacity))
        gaps = gaps.filter(F.col("gap") >= min(sizes)).unionByName(
            spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap")))
        opened += new
        n_rows, n_gaps = sum(sizes.values()) + sum(free.values()) + new, sum(free.values()) + new
        if n_rows <= FINISH_ROWS:
            rounds.append(f"{folder}/{len(rounds)}")
            _finished(left, gaps, opened, capacity).write.parquet(rounds[-1])
            break
        groups = -(-n_rows // ROWS_PER_TASK)
        tasks = min(most, groups)
        units = _bundled(left, (room + new * capacity) / n_gaps / 4, -(-sum(sizes.values()) // ROWS_PER_TASK)).coalesce(tasks)
        one_each = units.filter("item = unit").select("unit", "size")
        rounds.append(f"{folder}/{len(rounds)}")
        with _plain(spark, n_rows):
            pairs = saved(_sweep(one_each, gaps, tasks, groups), "packing-pairs")
            items_now = units.join(pairs.select("unit", "seq", "gap"), "unit", "left").select(
                F.lit(0).alias("kind"), "item", "length", "seq", (F.lit(capacity) - F.col("gap") + F.col("inside")).alias("offset"))
            gaps_now = gaps.join(pairs.select("seq", "size"), "seq", "left").select(
                F.lit(1).alias("kind"), F.lit(None).cast("long").alias("item"), (F.col("gap") - F.coalesce("size", F.lit(0))).alias("length"), "seq",
                F.lit(None).cast("long").alias("offset"))
            items_now.unionByName(gaps_now).coalesce(tasks).write.parquet(rounds[-1])
        forget(pairs)
        now = spark.read.schema(STATE).parquet(rounds[-1])
        left = now.filter("kind = 0 and seq is null").select("item", "length")
        gaps = now.filter("kind = 1").select("seq", F.col("length").alias("gap"))
    if not rounds:
        return whole
    placed = spark.read.schema(STATE).parquet(*rounds).filter("kind = 0 and seq is not null")
    return whole.unionByName(placed.select("item", F.col("seq").alias("sequence_id"), "offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` ids as best fit can.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id
    and offset; the pieces of a sequence follow each other without a gap from 0.
    Null and empty texts are one id long; ties go by rank; an empty table packs into
    no sequence; other columns are not read.
    """
    cut = saved(pieces(docs, tokenizer, capacity, end_id).withColumn("item", F.monotonically_increasing_id()), "packing-pieces")
    placed = best_fit(docs.sparkSession, cut.select("item", "length"), capacity)
    return cut.join(placed, "item").drop("item")
