"""Model-free evaluation (M7-M18) over any scored frame ``(prob, label)``.

* AUC is the exact rank-sum form with tied scores averaged (equal to
  ``BinaryClassificationEvaluator(numBins=0)``), computed over per-score
  counts, so the ordered pass sees distinct scores, not rows.
* The threshold sweep buckets every probability once into 52 bins and
  reads all 51 thresholds from suffix sums of a 52-row histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking

# ---- fixed values: sweep grid, warnings, tiers and gates --------------------
SWEEP_START, SWEEP_STOP, SWEEP_STEPS = 0.25, 0.75, 51
SWEEP_METRICS = ("f1", "precision", "recall")
BOUNDARY_LO, BOUNDARY_HI = 0.27, 0.73
DEGENERATE_HI, DEGENERATE_LO = 0.95, 0.05
AUC_TIERS = [(0.80, "good"), (0.70, "acceptable"), (0.60, "weak")]
AUC_TIER_ELSE = "near_random"
GATE_F1, GATE_AUC, GATE_PRECISION = 0.70, 0.75, 0.80
# ------------------------------------------------------------------------------


def auc(scored: DataFrame, prob: str = "prob", label: str = "label", groups: list[str] | None = None) -> DataFrame:
    """M7: exact ROC AUC per group; NULL when a group has one class only."""
    groups = groups or []
    s = scored.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).select(
        *groups, F.col(prob).alias("_p"), F.col(label).cast("int").alias("_y"))
    vc = s.groupBy(*groups, "_p").agg(F.count(F.lit(1)).alias("cnt"), F.sum("_y").alias("npos"))
    pos = ranking.positions(vc, groups, "_p")
    r = pos.groupBy(*groups).agg(
        F.sum(F.col("npos") * (F.col("before") + (F.col("cnt") + 1) / 2.0)).alias("_rs"),
        F.sum("npos").alias("n_pos"), F.sum(F.col("cnt") - F.col("npos")).alias("n_neg"),
    )
    n_pos, n_neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")  # their products pass the range of a long
    a = (F.col("_rs") - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)
    return r.select(*groups, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), a).alias("auc_roc"),
                    "n_pos", "n_neg")


def _safe_div(a: Column, b: Column) -> Column:
    """M9: zero when undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(scored: DataFrame, threshold: float, prob: str = "prob", label: str = "label") -> DataFrame:
    """M8 + M9 + M11 + M12: one aggregate over the scored rows."""
    y = F.col(label).cast("int")
    p = (F.col(prob) >= F.lit(threshold)).cast("int")
    s = scored.where(F.col(prob).isNotNull() & F.col(label).isNotNull())
    c = s.agg(
        F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"), F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"), F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"),
        F.count(F.lit(1)).alias("n_test"), F.avg(y).alias("positive_rate_test"), F.avg(p).alias("positive_rate_pred"),
    )
    prec = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": prec, "recall": rec}).withColumns(
        {
            "f1": _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
            "threshold": F.lit(threshold),
            "degenerate": F.when(F.col("positive_rate_pred") >= DEGENERATE_HI, F.lit("all_positive"))
            .when(F.col("positive_rate_pred") <= DEGENERATE_LO, F.lit("all_negative")),
        }
    )


def class_report(scored: DataFrame, threshold: float, prob: str = "prob", label: str = "label") -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    c = confusion(scored, threshold, prob, label)
    rows = []
    for cls, tp, fp, fn in ((0, "tn", "fn", "fp"), (1, "tp", "fp", "fn")):
        pr = _safe_div(F.col(tp), F.col(tp) + F.col(fp))
        rc = _safe_div(F.col(tp), F.col(tp) + F.col(fn))
        rows.append(c.select(F.lit(str(cls)).alias("label"), pr.alias("precision"), rc.alias("recall"),
                             _safe_div(2 * pr * rc, pr + rc).alias("f1"), (F.col(tp) + F.col(fn)).alias("support")))
    per = rows[0].unionByName(rows[1])
    tot = F.sum("support")
    avg = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support"))
    wavg = per.agg(F.lit("weighted avg").alias("label"),
                   (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                   (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                   (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("support"))
    acc = c.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"),
                   _safe_div(F.col("tp") + F.col("tn"), F.col("n_test")).alias("f1"), F.col("n_test").alias("support"))
    return per.unionByName(acc).unionByName(avg).unionByName(wavg)


def sweep_thresholds(spark) -> DataFrame:  # noqa: ANN001
    """The 51 sweep thresholds, bit-equal to ``linspace(0.25, 0.75, 51)``."""
    i = F.col("i")
    thr = F.when(i == SWEEP_STEPS - 1, F.lit(SWEEP_STOP)).otherwise(
        i.cast("double") * F.lit((SWEEP_STOP - SWEEP_START) / (SWEEP_STEPS - 1)) + F.lit(SWEEP_START))
    return spark.range(SWEEP_STEPS).select(F.col("id").cast("int").alias("i")).withColumn("threshold", thr)


def _thr(i: Column) -> Column:
    return F.when(i == SWEEP_STEPS - 1, F.lit(SWEEP_STOP)).otherwise(
        i.cast("double") * F.lit((SWEEP_STOP - SWEEP_START) / (SWEEP_STEPS - 1)) + F.lit(SWEEP_START))


def threshold_sweep(scored: DataFrame, metric: str = "f1", prob: str = "prob", label: str = "label") -> DataFrame:
    """M13 + M15: metrics at the 51 thresholds; the first maximum is flagged.

    Every probability is bucketed once: k = number of thresholds ≤ p (an
    estimate from arithmetic, corrected by exact comparisons with the two
    neighbouring thresholds).  Then TP(i) = positives with k > i, a suffix
    sum over a 52-row histogram.
    """
    if metric not in SWEEP_METRICS:
        raise ValueError(f"unknown sweep metric {metric!r}; use one of {SWEEP_METRICS}")
    p = F.col(prob)
    est = F.least(F.greatest(F.floor((p - SWEEP_START) / ((SWEEP_STOP - SWEEP_START) / (SWEEP_STEPS - 1))) + 1,
                             F.lit(0)), F.lit(SWEEP_STEPS)).cast("int")
    k = (F.when((est >= 1) & (p < _thr(est - 1)), est - 1)
         .when((est <= SWEEP_STEPS - 1) & (p >= _thr(est)), est + 1).otherwise(est))
    s = scored.where(p.isNotNull() & F.col(label).isNotNull())
    hist = s.groupBy(k.alias("k")).agg(F.sum(F.col(label).cast("int")).alias("pos"),
                                       F.count(F.lit(1)).alias("cnt"))
    # 51 thresholds × ≤ 52 histogram rows: a bounded product of two tiny tables
    th = sweep_thresholds(scored.sparkSession)
    over = F.col("k") > F.col("i")
    m = th.join(F.broadcast(hist), F.lit(True), "left").groupBy("i", "threshold").agg(
        F.coalesce(F.sum(F.when(over, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(over, F.col("cnt") - F.col("pos"))), F.lit(0)).alias("fp"), F.sum("pos").alias("_all"))
    m = m.withColumns({"precision": _safe_div(F.col("tp"), F.col("tp") + F.col("fp")),
                       "recall": _safe_div(F.col("tp"), F.col("_all"))})
    m = m.withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    w = Window.orderBy(F.col(metric).desc(), F.col("i").asc())  # 51 rows
    m = m.withColumn("_r", F.row_number().over(w))
    return m.select("i", "threshold", "tp", "fp", "precision", "recall", "f1", (F.col("_r") == 1).alias("is_best"),
                    ((F.col("threshold") <= BOUNDARY_LO) | (F.col("threshold") >= BOUNDARY_HI)).alias("at_boundary"))


def auc_tier(a: Column) -> Column:
    """M16."""
    out = None
    for cut, name in AUC_TIERS:
        out = F.when(a >= cut, F.lit(name)) if out is None else out.when(a >= cut, F.lit(name))
    return out.otherwise(F.lit(AUC_TIER_ELSE))


def acceptance_gate(f1: Column, auc_col: Column, precision: Column) -> Column:
    """M17."""
    return (f1 >= GATE_F1) & (auc_col >= GATE_AUC) & (precision >= GATE_PRECISION)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """M18: 'balanced' class weights n / (k · n_c) as a small per-class table."""
    vc = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    every = Window.partitionBy()  # one row per class
    return vc.withColumn("weight", F.sum("n_class").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_class")))
