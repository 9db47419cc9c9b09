"""Filter interaction audit: what each filter removes in every order of the filters.

Duplicates are found by an existential self-join: documents left-semi joined on hash,
exact text and a smaller doc_id.  The ids found are united with the ids that fail the
other filters, each id's failures become one bit mask, and everything else is a sum
over the masks of a part, of which there are at most two to the power of the filters.

The right side of the semi-join is one row per text that occurs more than once, with
its smallest doc_id.  Hashes that hold over 1/1000 of all rows (so fewer than 1000 of
them) are split by a salt on both sides.

Nulls and odd rows: a null text counts as empty, a null part as "".  A row without
doc_id never fails the duplicate filter and has no labels; it is no original either.
Rows with one doc_id count one by one, and don't duplicate one another.  Of several
labels of a doc_id the largest counts.  An empty table gives no rows.  Other columns
of the table are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .store import saved

#: a hash with over 1 / SHARE of all rows is split into parts of about that size
SHARE = 1000
DUPLICATE = "E"


def words(text: Column) -> Column:
    """Maximal runs of anything but 0x20 and 0x09-0x0D."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions by letter; the duplicate filter, which needs all rows, isn't among them."""
    found = words(text)
    n, distinct = F.size(found), F.size(F.array_distinct(found))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def duplicates(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(doc_id, h) of the rows whose text another row with a smaller doc_id has.

    docs: doc_id, h, text; hashed: at least the column h of the same rows, written.
    """
    rows = hashed.count()
    # fewer than SHARE hashes hold over 1 / SHARE of the rows each: bounded, whatever the size
    hot = hashed.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") * SHARE > rows)
    hot = hot.select("h", F.ceil(F.col("n") * SHARE / F.lit(max(rows, 1))).cast("int").alias("splits"))
    keyed = docs.join(F.broadcast(hot), "h", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("splits")).cast("int")).repartition("h", "salt", "text")

    texts = keyed.groupBy("h", "salt", "text", "splits").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1 or splits > 1")
    texts = texts.groupBy("h", "text", "splits").agg(F.min("least").alias("least"))
    texts = texts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    copy, other = keyed.alias("copy"), texts.alias("other")
    same = [F.col(f"copy.{c}") == F.col(f"other.{c}") for c in ("h", "salt", "text")]
    return copy.join(other, same[0] & same[1] & same[2] & (F.col("other.least") < F.col("copy.doc_id")), "left_semi").select("doc_id", "h")


def failures(docs: DataFrame, part: str) -> tuple[DataFrame, list[str]]:
    """(doc_id, part, mask, n): rows by the filters they fail (bit i is the i-th letter), and the letters."""
    own = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    fails = conditions(F.col("text"))
    letters = [*fails, DUPLICATE]
    bits = [F.when(c, F.lit(1 << i)) for i, c in enumerate(fails.values())]
    facts = saved(own.select("doc_id", "part", "h", F.array_compact(F.array(*bits)).alias("bits")), "audit-facts")

    ids = facts.select("doc_id", "h", F.explode("bits").alias("bit"))
    ids = ids.unionByName(duplicates(own.select("doc_id", "h", "text"), facts).withColumn("bit", F.lit(1 << len(fails))))
    masks = ids.groupBy("doc_id", "h").agg(F.bit_or("bit").alias("mask")).alias("m")
    rows = facts.groupBy("doc_id", "h", "part").agg(F.count("*").alias("n")).alias("r")
    joined = rows.join(masks, F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.h") == F.col("m.h")), "left")
    return joined.select("r.doc_id", "r.h", "part", "n", F.coalesce("mask", F.lit(0)).alias("mask")), letters


def combinations(docs: DataFrame, labels: DataFrame, part: str = "lang") -> tuple[DataFrame, list[str]]:
    """(part, mask, n, good, toxic): how many rows fail exactly the filters of the mask, and the letters."""
    rows, letters = failures(docs, part)
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("doc_id is not null")
    # rows without doc_id meet nothing; their hash keeps them out of one task
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("h"))).alias("r")
    marks = marks.withColumn("spread", F.lit(None).cast("long")).alias("k")
    rows = rows.join(marks, (F.col("r.doc_id") == F.col("k.doc_id")) & F.col("r.spread").eqNullSafe(F.col("k.spread")), "left")
    counted = lambda c: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("quality").alias("good"), counted("toxic").alias("toxic")), letters


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; counts of rows of the part.

    kept: pass all filters up to this step; removed: fail it and pass all before;
    redundant: fail it and one before; unique_fails: fail it alone; good_lost and
    toxic_lost: removed rows so labelled; shapley: removed by this filter in all orders.
    """
    counts, letters = combinations(docs, labels, part)
    steps = []
    for order in permutations(range(len(letters))):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append((name, step, letters[i], 1 << i, before))
            before |= 1 << i
    # its size depends on the number of filters alone
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, bit int, before int")
    steps = steps.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when, n="n": F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0))
    found = counts.join(F.broadcast(steps), "mask").groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


ORACLE = """
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    m AS (
        SELECT part, doc_id, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
            + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
            + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
            + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS mask
        FROM w),
    l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
    c AS (
        SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
        FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS filter, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (
        SELECT [a.filter, b.filter, c.filter, d.filter, e.filter] AS names, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
    s AS (
        SELECT array_to_string(names, '') AS filter_order, i::INTEGER AS step, names[i] AS filter, bits[i] AS bit,
               coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS earlier
        FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
    r AS (
        SELECT part, filter_order, step, filter,
               coalesce(sum(n) FILTER (mask & (bit | earlier) = 0), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
               coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
        FROM c, s GROUP BY ALL)
    SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r"""
