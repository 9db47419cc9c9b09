"""Preparation and splitting (D-series): imputation fitted on train only,
ordinal encoding with -1 for unseen, spatial hold-out, grouped folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RANDOM_STATE
from . import ranking, selection
from .datasets import hash_order
from .joins import bounded_broadcast


def fit_medians(train: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact interpolated medians (SQL ``median``, not Imputer's, trap 4).

    An all-null column is an error naming the column (trap 26).
    """
    found = selection.quantiles(train, cols, [0.5])
    got = {c: found[None, c].quantile(0.5) for c in cols}
    empty = [c for c in cols if got.get(c) is None]
    if empty:
        raise ValueError(f"cannot impute all-null column(s): {empty}")
    return got


def apply_fill(df: DataFrame, values: dict[str, float | int | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items()})


def fit_mode(train: DataFrame, col: str):  # noqa: ANN201
    """Most frequent value, smallest on ties (value counts + top-1)."""
    row = (train.where(F.col(col).isNotNull()).groupBy(col).count()
           .orderBy(F.col("count").desc(), F.col(col).asc()).limit(1).first())
    if row is None:
        raise ValueError(f"cannot impute all-null column: {col}")
    return row[col]


def fit_ordinal(train: DataFrame, col: str) -> DataFrame:
    """D3: sorted distinct categories → code 0..k-1 (a small category table)."""
    cats = train.where(F.col(col).isNotNull()).select(col).distinct()
    return ranking.row_numbers(cats, [col], "_code").select(col, (F.col("_code") - 1).alias("code"))


def apply_ordinal(df: DataFrame, col: str, codes: DataFrame, out: str) -> DataFrame:
    """D3 apply: left join to the category table; unseen (or null) → -1."""
    c = codes.withColumnRenamed("code", out)
    return df.join(bounded_broadcast(c), col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)).cast("int"))


def test_groups(df: DataFrame, group: str, k: int = 2) -> DataFrame:
    """The last ``min(k, n-1)`` group ids in sorted order (traps 9, 10)."""
    ids = df.select(group).distinct()
    n = ids.count()
    if n < 2:
        raise ValueError("spatial split needs at least two groups")
    return ids.orderBy(F.col(group).desc()).limit(min(k, n - 1))


def spatial_split(df: DataFrame, group: str, k: int = 2) -> DataFrame:
    """D5 + P11: ``split`` = test for rows of the held-out groups (a ≤ k-row table)."""
    t = test_groups(df, group, k).withColumn("_test", F.lit(True))
    return df.join(F.broadcast(t), group, "left").withColumn(
        "split", F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_test")


def _deal(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Greedy dealing of ``(group size, number of groups)``, largest first.

    Each group goes to the least-filled fold (the lowest one on ties).  Groups
    of one size go round the folds that lie less than that size apart, so a
    whole stretch is one row: (size, first rank, rank after the last, folds in turn).
    """
    load = [0] * k
    out: list[tuple[int, int, int, list[int]]] = []
    for size, many in sorted(sizes, reverse=True):
        rank = 0
        while rank < many:
            turn = sorted(range(k), key=lambda i: (load[i], i))
            low = [i for i in turn if load[i] < load[turn[0]] + size]
            others = [load[i] for i in turn if i not in low]
            rounds = (many - rank) // len(low)
            if others:
                rounds = min(rounds, (min(others) - load[low[-1]] - 1) // size + 1)
            step, taken = (rounds * len(low), low) if rounds else (1, low[:1])
            for i in taken:
                load[i] += size * max(rounds, 1)
            out.append((size, rank, rank + step, taken))
            rank += step
    return out


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Groups never split; largest group first to the least-filled fold.

    The greedy rule runs over the histogram (group size, number of groups): n
    rows have at most about sqrt(2n) different group sizes, however many groups
    there are.  A group finds its fold by its rank, in order of its id, among
    the groups of its size.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"), F.lit(1).cast("long").alias("cnt"))
    ranked = ranking.positions(counts, ["_size"], group).withColumnRenamed("before", "_r")
    sizes = [(r["_size"], r["m"]) for r in ranked.groupBy("_size").agg(F.max("n").alias("m")).collect()]
    dealt = df.sparkSession.createDataFrame(_deal(sizes, k), "_size long, first long, after long, turn array<int>")
    found = ranked.join(dealt, "_size").where((F.col("_r") >= F.col("first")) & (F.col("_r") < F.col("after")))
    turn = F.element_at("turn", ((F.col("_r") - F.col("first")) % F.size("turn") + 1).cast("int"))
    return found.select(group, turn.alias("fold"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = RANDOM_STATE) -> DataFrame:
    """Per class, rows in the seeded hash order dealt round-robin to k folds."""
    order = hash_order(key, seed)
    r = ranking.row_numbers(df.withColumn("_h", order[0]), ["_h", key], "_rn", groups=[label])
    return r.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_h", "_rn")


def n_folds(n_groups: int, k: int = 5) -> tuple[str, int]:
    """Grouped CV when there are at least k groups, else stratified with max(2, groups) folds."""
    return ("group", k) if n_groups >= k else ("stratified", max(2, n_groups))


def with_cv_folds(df: DataFrame, group: str, label: str, key: str, k: int = 5) -> DataFrame:
    """D6 or D7: add ``fold``; groups stay whole where there are enough of them."""
    kind, folds = n_folds(df.select(group).distinct().count(), k)
    if kind == "stratified":
        return stratified_folds(df, label, key, folds)
    dealt = group_folds(df, group, folds).withColumnRenamed(group, "_group")
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")  # null is a group too
