"""Exact ranks, quantiles and row numbers without a single-task window.

Everything starts from value counts: ``(group…, value) -> cnt``, a
pre-aggregation that shrinks the data before any ordered pass.  The ordered
pass then runs over distinct values:

* when every group has at most ``max_window`` distinct values, one window
  partitioned by the group computes running counts (each task holds one
  group's distinct values — bounded by the check);
* otherwise the counts are range-partitioned on (group, value) and written
  with their partition number, so that numbers never depend on a cache or on
  how a plan is recomputed; each partition totals its rows per group, and
  running counts inside a partition plus the offset of all earlier partitions
  (a window over one row per partition and group) give the global position.

Both give the same rows; null is a group of its own.

``before`` is the number of rows of the group strictly before the value,
``n`` the group's row count.  Average rank of a value = before + (cnt+1)/2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cached, written

DEFAULT_MAX_WINDOW = 2_000_000


def value_counts(df: DataFrame, groups: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(groups…, value) → cnt (rows with a null value are skipped)."""
    agg = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(agg.alias("cnt"))


def positions(vc: DataFrame, groups: list[str], value: str, max_window: int = DEFAULT_MAX_WINDOW) -> DataFrame:
    """Add ``before`` and ``n`` to value counts (see module doc).

    The counts are persisted first: the size check and the ordered pass then
    read them once instead of recomputing the upstream plan twice.
    """
    vc = cached(vc)
    widest = vc.groupBy(*groups).count().agg(F.max("count")).first()[0] if groups else vc.count()
    if widest is None or widest <= max_window:
        w = Window.partitionBy(*groups).orderBy(value)
        wall = Window.partitionBy(*groups)
        return vc.withColumns(
            {
                "before": F.coalesce(F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "n": F.sum("cnt").over(wall),
            }
        )
    return _positions_by_range(vc, groups, value)


def _in_ranges(df: DataFrame, groups: list[str], order: list[str], weight: Column) -> DataFrame:
    """Range-partitioned rows with ``_pid``, ``_off`` (weight of the group's earlier
    partitions) and ``_all`` (weight of the group)."""
    r = written(df.repartitionByRange(*groups, *order).withColumn("_pid", F.spark_partition_id()), "ranges")
    totals = r.groupBy("_pid", *groups).agg(F.sum(weight).alias("_t"))
    group = Window.partitionBy(*groups)
    earlier = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_pid", *groups, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"), F.sum("_t").over(group).alias("_all"))
    same = F.col("r._pid") == F.col("t._pid")
    for g in groups:
        same = same & F.col(f"r.`{g}`").eqNullSafe(F.col(f"t.`{g}`"))
    return r.alias("r").join(totals.alias("t"), same).select("r.*", "t._off", "t._all")


def _positions_by_range(vc: DataFrame, groups: list[str], value: str) -> DataFrame:
    w = Window.partitionBy("_pid", *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = _in_ranges(vc, groups, [value], F.col("cnt"))
    return out.withColumns({"before": F.coalesce(F.sum("cnt").over(w), F.lit(0)) + F.col("_off"), "n": F.col("_all")}).drop("_pid", "_off", "_all")


def quantile_aggs(probs: list[float], value: str = "value", names: list[str] | None = None) -> list[Column]:
    """Aggregates over ``positions`` output giving linear-interpolated quantiles
    at position p·(n-1)."""
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("cnt"))
        vlo = F.min(F.when(at(lo), F.col(value)))
        vhi = F.min(F.when(at(hi), F.col(value)))
        frac = F.first(pos - lo)
        val = F.when(F.first(hi == lo), vlo).otherwise(vlo + (vhi - vlo) * frac)
        out.append(val.alias(names[i] if names else f"q{p}"))
    return out


def quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float],
              names: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Exact quantiles of ``value`` per group.

    ``accuracy``: use ``percentile_approx`` instead (one pass, bounded
    memory per group, relative rank error 1/accuracy) where exactness is
    not needed.
    """
    names = names or [f"q{p}" for p in probs]
    if accuracy:
        qa = F.percentile_approx(value, probs, accuracy)
        out = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(qa.alias("_q"))
        return out.select(*groups, *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)])
    pos = positions(value_counts(df, groups, value), groups, value)
    return pos.groupBy(*groups).agg(*quantile_aggs(probs, value, names))


def quantile_value(df: DataFrame, value: str, p: float) -> float | None:
    """One exact quantile as a Python float (a scalar read, one small job)."""
    row = quantiles(df.select(value), [], value, [p], ["q"]).first()
    return None if row is None else row["q"]


def average_ranks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups…, value, cnt, avg_rank, n): 1-based average rank of every distinct value."""
    pos = positions(value_counts(df, groups, value), groups, value)
    return pos.withColumn("avg_rank", F.col("before") + (F.col("cnt") + 1) / 2.0)


def row_numbers(df: DataFrame, order: list[str], out: str = "seq", groups: list[str] | None = None) -> DataFrame:
    """P13 / trap 12: consecutive 1-based row numbers in a total order (per
    group when ``groups`` is given), without pulling a group into one task.

    ``order`` must be unique within a group.  Null is a group of its own.
    """
    groups = groups or []
    w = Window.partitionBy("_pid", *groups).orderBy(*order)
    return _in_ranges(df, groups, order, F.lit(1)).withColumn(out, F.row_number().over(w) + F.col("_off")).drop("_pid", "_off", "_all")
