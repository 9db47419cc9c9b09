"""Profiling aggregates (A-series) over a wide zone table.

Column-wise statistics go through one ``unpivot`` to ``(feature, value)`` and
a single ``groupBy("feature")``: one shuffle for all columns, partial
aggregation on the map side.  Quantiles are exact and distributed
(``selection``), never a sort of all values.  Correlations use raw moments with
explicit guards instead of ``corr`` (traps 5, 25).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking, selection

# fixed values: thresholds of the profiling report
REDUNDANT_ABS_R = 0.70
WEAK_ABS_R = 0.05
SIGNAL_ABS_R = 0.20
IQR_K = 1.5
HIST_BINS = 30
BALANCE_SEVERE_LO, BALANCE_SEVERE_HI = 0.15, 0.75
BALANCE_OK_LO, BALANCE_OK_HI = 0.30, 0.70


def long_form(df: DataFrame, features: list[str], ids: list[str] | None = None, keep_nulls: bool = False) -> DataFrame:
    """Unpivot features to ``(ids…, feature, value double)``."""
    ids = ids or []
    wide = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    out = wide.unpivot(ids, features, "feature", "value")
    return out if keep_nulls else out.where(F.col("value").isNotNull())


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """Count, mean, std (sample), min, quartiles, max per feature."""
    lf = long_form(df, features)
    basic = lf.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    found = selection.quantiles(df, features, [0.25, 0.5, 0.75])
    rows = [(c, *[found[None, c].quantile(p) for p in (0.25, 0.5, 0.75)]) for c in features]
    q = df.sparkSession.createDataFrame(rows, "feature string, p25 double, p50 double, p75 double")
    return basic.join(F.broadcast(q), "feature", "left")  # a row a feature


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls per column (one pass, then unpivot of a single row)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    lf = row.unpivot(["_n"], cols, "feature", "non_null")
    return lf.select("feature", (F.col("_n") - F.col("non_null")).alias("n_null"),
                     F.round((F.col("_n") - F.col("non_null")) / F.col("_n"), 6).alias("pct_null"))


def distinct_counts(df: DataFrame, features: list[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per feature (approx option for scale)."""
    lf = long_form(df, features)
    agg = F.approx_count_distinct("value") if approx else F.countDistinct("value")
    return lf.groupBy("feature").agg(agg.alias("n_distinct"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A2 / A3: counts per value, null kept as its own group, with share."""
    vc = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = vc.agg(F.sum("count")).scalar()  # scalar subquery over the counts, no single-partition window
    return vc.withColumn("share", F.round(F.col("count") / total, 6))


def crosstab(df: DataFrame, group: str, target: str, classes: tuple = (0, 1)) -> DataFrame:
    """A4: group × class counts, zero-filled, over a fixed class list."""
    aggs = [F.count(F.when(F.col(target) == F.lit(c), 1)).alias(f"n_{c}") for c in classes]
    return df.groupBy(group).agg(*aggs)


def target_correlations(df: DataFrame, features: list[str], target: str, spearman: bool = True,
                        unique: bool = False) -> DataFrame:
    """A10 + A11 + A15: per feature, over pairwise-complete rows.

    pearson / spearman are NULL when fewer than 3 valid pairs, fewer than 2
    distinct feature values, or a constant target among the valid pairs.
    Also: n_valid, missing, mean_when_target_0/1, and unique_values where
    ``unique`` asks for it (exact distinct counts shuffle all values).
    """
    lf = long_form(df, features, [target], keep_nulls=True)
    lf = lf.withColumn("t", F.col(target).cast("double"))
    valid = F.col("value").isNotNull() & F.col("t").isNotNull()
    x, t = F.when(valid, F.col("value")), F.when(valid, F.col("t"))
    stats = lf.groupBy("feature").agg(
        F.count(x).alias("n_valid"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("missing"),
        (F.countDistinct("value") if unique else F.lit(None).cast("long")).alias("unique_values"),
        F.min(x).alias("_xmin"), F.max(x).alias("_xmax"),
        F.min(t).alias("_tmin"), F.max(t).alias("_tmax"),
        F.covar_pop(x, t).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(t).alias("_vt"),
        F.avg(F.when(valid & (F.col("t") == 0), F.col("value"))).alias("mean_when_target_0"),
        F.avg(F.when(valid & (F.col("t") == 1), F.col("value"))).alias("mean_when_target_1"),
    )
    ok = (F.col("n_valid") >= 3) & (F.col("_xmin") != F.col("_xmax")) & (F.col("_tmin") != F.col("_tmax"))
    stats = stats.withColumn("pearson_vs_target", F.when(ok, pearson("_c", "_vx", "_vt")))
    if not spearman:
        return stats.select(
            "feature", "pearson_vs_target", F.lit(None).cast("double").alias("spearman_vs_target"),
            F.abs("pearson_vs_target").alias("abs_pearson"), "n_valid", "missing", "unique_values",
            "mean_when_target_0", "mean_when_target_1")
    # Spearman: Pearson over average ranks within the valid pairs
    vp = lf.where(valid).select("feature", "value", "t")
    # one rank pass for both sides: value counts of x and of t, told apart by "side"
    vc = ranking.value_counts(vp, ["feature"], "value").withColumn("side", F.lit("x")).unionByName(
        ranking.value_counts(vp.select("feature", F.col("t").alias("value")), ["feature"], "value")
        .withColumn("side", F.lit("t")))
    rk = ranking.positions(vc, ["feature", "side"], "value").withColumn(
        "avg_rank", F.col("before") + (F.col("cnt") + 1) / 2.0)
    xr = rk.where(F.col("side") == "x").select("feature", "value", F.col("avg_rank").alias("rx"))
    tr = rk.where(F.col("side") == "t").select("feature", F.col("value").alias("t"), F.col("avg_rank").alias("rt"))
    # ranks are attached to (feature, value, t) counts, never to the raw rows: a
    # value shared by a third of the rows is one weighted row here
    cells = vp.groupBy("feature", "value", "t").agg(F.count(F.lit(1)).alias("w"))
    ranked = cells.join(xr, ["feature", "value"]).join(tr, ["feature", "t"])
    w, rx, rt = F.col("w"), F.col("rx"), F.col("rt")
    m = ranked.groupBy("feature").agg(
        F.sum(w).alias("_n"), F.sum(w * rx).alias("_sx"), F.sum(w * rt).alias("_st"),
        F.sum(w * rx * rx).alias("_sxx"), F.sum(w * rt * rt).alias("_stt"), F.sum(w * rx * rt).alias("_sxt"))
    n = F.col("_n")
    sp = m.select(
        "feature",
        (F.col("_sxt") / n - F.col("_sx") / n * (F.col("_st") / n)).alias("_c"),
        (F.col("_sxx") / n - F.col("_sx") / n * (F.col("_sx") / n)).alias("_vx"),
        (F.col("_stt") / n - F.col("_st") / n * (F.col("_st") / n)).alias("_vt"),
    ).select("feature", pearson("_c", "_vx", "_vt").alias("_sp"))
    out = stats.join(sp, "feature", "left").withColumn("spearman_vs_target", F.when(ok, F.col("_sp")))
    return out.select(
        "feature", "pearson_vs_target", "spearman_vs_target", F.abs("pearson_vs_target").alias("abs_pearson"),
        "n_valid", "missing", "unique_values", "mean_when_target_0", "mean_when_target_1",
    )


def pearson(cov: str, vx: str, vy: str) -> Column:
    """r from population moments; NULL when either variance is 0 (no division error)."""
    den = F.sqrt(F.col(vx) * F.col(vy))
    return F.when(den > 0, F.try_divide(F.col(cov), den))


#: rows whose products are summed at once
GRAM_ROWS = 4096


def corr_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """Every feature pair i<j, Pearson over the rows where both are present.

    One pass of masked Gram matrices: with X the values less a common centre (0 where
    missing) and M 1 where present, a block's X'X, X'M, (X*X)'M and M'M hold all sums
    that any pair needs over its own rows.  Blocks are added up in their task, so a task hands
    on k x k rows whatever its input; nothing is expanded by row.  The centre (a
    column's mean) keeps the sums small, as they are subtracted in the end.  NULL for a column
    constant within the pair.
    """
    names = list(features)
    means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(str(i)) for i, c in enumerate(names)]).first()
    centre = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])
    k = len(names)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, GRAM_ROWS):
                part = batch.slice(at, GRAM_ROWS)
                x = np.stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in part.columns], axis=1) - centre
                there = ~np.isnan(x)
                x, m = np.where(there, x, 0.0), there.astype(float)
                sums += np.stack((x.T @ x, x.T @ m, (x * x).T @ m, m.T @ m))
        i, j = np.triu_indices(k, 1)
        cells = (sums[3][i, j], sums[1][i, j], sums[1][j, i], sums[2][i, j], sums[2][j, i], sums[0][i, j])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *map(pa.array, cells)], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    parts = values.mapInArrow(grams, "i long, j long, n double, x double, y double, xx double, yy double, xy double")
    agg = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    mean_of = lambda total, a, b: F.try_divide(F.col(total), F.col("n")) - F.try_divide(F.col(a) * F.col(b), F.col("n") * F.col("n"))
    agg = agg.withColumns({"_c": mean_of("xy", "x", "y"), "_va": mean_of("xx", "x", "x"), "_vb": mean_of("yy", "y", "y")})
    # what is left of a constant column by rounding is no variance
    for v, square in (("_va", "xx"), ("_vb", "yy")):
        agg = agg.withColumn(v, F.when(F.col(v) > 1e-13 * F.try_divide(F.col(square), F.col("n")), F.col(v)).otherwise(F.lit(0.0)))
    label = F.array(*[F.lit(f) for f in names])
    return agg.select(F.element_at(label, (F.col("i") + 1).cast("int")).alias("feature_a"), F.element_at(label, (F.col("j") + 1).cast("int")).alias("feature_b"),
                      F.col("n").cast("long").alias("n"), pearson("_c", "_va", "_vb").alias("r"))


def redundant_pairs(pairs: DataFrame, threshold: float = REDUNDANT_ABS_R) -> DataFrame:
    """|r| ≥ threshold, strongest first."""
    return pairs.where(F.abs("r") >= threshold).orderBy(F.abs("r").desc(), "feature_a", "feature_b")


def iqr_outliers(df: DataFrame, features: list[str], k: float = IQR_K) -> DataFrame:
    """Per feature, strict fences q1 - k·IQR / q3 + k·IQR; count and % outside."""
    lf = long_form(df, features)
    found = selection.quantiles(df, features, [0.25, 0.75])
    rows = [(c, found[None, c].quantile(0.25), found[None, c].quantile(0.75)) for c in features]
    q = df.sparkSession.createDataFrame(rows, "feature string, q1 double, q3 double")
    q = q.withColumns({c: F.round(c, 9) for c in ("q1", "q3")}).withColumns({"lower_fence": F.col("q1") - k * (F.col("q3") - F.col("q1")),
                       "upper_fence": F.col("q3") + k * (F.col("q3") - F.col("q1"))})
    j = lf.join(F.broadcast(q), "feature")  # one row per feature: bounded by the feature list
    return j.groupBy("feature", "lower_fence", "upper_fence").agg(
        F.count(F.when((F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence")), 1))
        .alias("n_outliers"),
        F.count(F.lit(1)).alias("_n"),
    ).select("feature", "n_outliers", F.round(F.col("n_outliers") / F.col("_n") * 100, 2).alias("pct_outliers"),
             F.round("lower_fence", 3).alias("lower_fence"), F.round("upper_fence", 3).alias("upper_fence"))


def class_histogram(df: DataFrame, features: list[str], target: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins over each (feature, class)'s own range; density.

    The last bin is closed (trap 13); a constant range puts everything in
    bin 0 with width 1 (density as NumPy's degenerate range of ±0.5).
    """
    lf = long_form(df, features, [target]).where(F.col(target).isNotNull())
    rng = lf.groupBy("feature", target).agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                             F.count(F.lit(1)).alias("n"))
    j = lf.join(F.broadcast(rng), ["feature", target])  # ≤ features × classes rows
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0 / bins))
    lo = F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5)
    b = F.least(F.floor((F.col("value") - lo) / width), F.lit(bins - 1)).cast("int")
    h = j.withColumns({"bin": b, "width": width}).groupBy("feature", target, "bin", "n", "width").agg(
        F.count(F.lit(1)).alias("count"))
    return h.select("feature", target, "bin", "count",
                    F.round(F.col("count") / (F.col("n") * F.col("width")), 6).alias("density"))


def box_stats(df: DataFrame, features: list[str], target: str, k: float = IQR_K) -> DataFrame:
    """Per (feature, class): quartiles, whiskers (furthest value inside the fences), fliers."""
    lf = long_form(df, features, [target]).where(F.col(target).isNotNull())
    classes = [r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().collect()]  # a row a class
    found = selection.quantiles(df, features, [0.25, 0.5, 0.75], target, {c: [c] for c in classes})
    rows = [(c, k, *[found[k, c].quantile(p) for p in (0.25, 0.5, 0.75)]) for c in features for k in classes]
    kind = df.schema[target].dataType.simpleString()
    q = df.sparkSession.createDataFrame(rows, f"feature string, {target} {kind}, q1 double, median double, q3 double")
    q = q.withColumns({c: F.round(c, 9) for c in ("q1", "median", "q3")}).withColumns({"_lo": F.col("q1") - k * (F.col("q3") - F.col("q1")),
                       "_hi": F.col("q3") + k * (F.col("q3") - F.col("q1"))})
    j = lf.join(F.broadcast(q), ["feature", target])
    inside = (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    return j.groupBy("feature", target, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count(F.when(~inside, 1)).alias("n_fliers"),
    )


def balance_flags(df: DataFrame, target: str) -> DataFrame:
    """A9 + A21: positive rate and balance verdicts."""
    r = F.col("positive_rate")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("positive_rate")).select(
        "n", F.round(r, 6).alias("positive_rate"),
        ((r < BALANCE_SEVERE_LO) | (r > BALANCE_SEVERE_HI)).alias("severe_imbalance"),
        ((r >= BALANCE_OK_LO) & (r <= BALANCE_OK_HI)).alias("balance_acceptable"),
    )
