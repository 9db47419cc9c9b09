"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, saved


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with ``m``, the least of u and all its v; minima are taken before any shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tied = _with_least(down)
    moved = tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(tied.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """(u, v): every linked node u that isn't the least of its component, and that least node v.

    links: (u, v) longs in either direction, repeats and loops allowed.  The table
    of links stays in Spark; two numbers a round come to the driver.
    """
    links = saved(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(links)
    while True:
        after = saved(_small_star(_large_star(links)), "links")
        seen, mark = mark, _mark(after)
        forget(links)
        links = after
        if mark == seen:
            return links
