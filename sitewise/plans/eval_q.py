"""Stage 5 queries: preparation, splits and model-free evaluation.

The evaluation set is the labelled zone table with the noise-free
probability as the score (F15) and the deterministic Bernoulli label (L3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import prep
from ..operators.datasets import hash_order_sql
from ..sources.tables import districts
from .profile_q import EDA_SQL, NUMERIC_EDA, eda_table
from .registry import query

THRESHOLD = 0.74

SCORED_SQL = EDA_SQL + """,
ev AS (SELECT candidate_id, district_id, prob_optimal AS prob, is_optimal AS label FROM eda
       WHERE prob_optimal IS NOT NULL AND is_optimal IS NOT NULL)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = eda_table(spark, sf_dir)
    return e.select("candidate_id", "district_id", "walkability_score", F.col("prob_optimal").alias("prob"),
                    F.col("is_optimal").alias("label"))


def _test_districts_sql(src: str = "eda") -> str:
    return f"(SELECT district_id FROM (SELECT DISTINCT district_id FROM {src}) ORDER BY district_id DESC LIMIT 2)"


@query(
    "spatial_split",
    "D5 K4 P11",
    EDA_SQL + f"""
SELECT CASE WHEN district_id IN {_test_districts_sql()} THEN 'test' ELSE 'train' END AS split,
       CAST(count(*) AS BIGINT) AS n, round(avg(is_optimal), 6) AS positive_rate
FROM eda GROUP BY 1""",
)
def spatial_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prep.spatial_split(eda_table(spark, sf_dir), "district_id", 2)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("is_optimal"), 6).alias("positive_rate"))


@query(
    "median_impute",
    "D1",
    EDA_SQL + f""",
m AS (SELECT {", ".join(f"median({c}) AS {c}_m" for c in NUMERIC_EDA)} FROM eda WHERE district_id NOT IN {_test_districts_sql()})
SELECT candidate_id, {", ".join(f"round(coalesce({c}, {c}_m), 6) AS {c}" for c in NUMERIC_EDA)} FROM eda, m""",
)
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every numeric column, medians of the train districts."""
    e = prep.spatial_split(eda_table(spark, sf_dir), "district_id", 2).withColumns({c: F.col(c).cast("double") for c in NUMERIC_EDA})
    out = prep.apply_fill(e, prep.fit_medians(e.where(F.col("split") == "train"), NUMERIC_EDA))
    return out.select("candidate_id", *[F.round(c, 6).alias(c) for c in NUMERIC_EDA])


@query(
    "mode_impute",
    "D2",
    EDA_SQL + f""",
gappy AS (SELECT candidate_id, district_id, walkability_score, CASE WHEN candidate_id % 13 <> 0 THEN land_use_encoded END AS land_use_encoded FROM eda),
m AS (SELECT {", ".join(f"(SELECT {c} FROM gappy WHERE district_id NOT IN {_test_districts_sql()} AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}_m" for c in ("walkability_score", "land_use_encoded"))})
SELECT candidate_id, coalesce(walkability_score, walkability_score_m) AS walkability_score,
       coalesce(land_use_encoded, land_use_encoded_m) AS land_use_encoded FROM gappy, m""",
)
def mode_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categorical feature (here with gaps) and one numeric column."""
    e = prep.spatial_split(eda_table(spark, sf_dir), "district_id", 2)
    e = e.withColumn("land_use_encoded", F.when(F.col("candidate_id") % 13 != 0, F.col("land_use_encoded")))
    train = e.where(F.col("split") == "train")
    cols = ("walkability_score", "land_use_encoded")
    return prep.apply_fill(e, {c: prep.fit_mode(train, c) for c in cols}).select("candidate_id", *cols)


@query(
    "ordinal_encode",
    "D3",
    EDA_SQL + f""",
d AS (SELECT n_nationkey AS district_id, n_name FROM nation),
e AS (SELECT eda.candidate_id, eda.district_id, d.n_name FROM eda LEFT JOIN d ON eda.district_id = d.district_id),
cats AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS code
         FROM (SELECT DISTINCT n_name FROM e WHERE district_id NOT IN {_test_districts_sql()} AND n_name IS NOT NULL))
SELECT e.candidate_id, CAST(coalesce(cats.code, -1) AS INTEGER) AS district_code
FROM e LEFT JOIN cats ON e.n_name = cats.n_name""",
)
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes fitted on train districts' names; the held-out districts are unseen → -1."""
    names = districts(spark, sf_dir).select("district_id", F.col("district_name").alias("n_name"))
    e = prep.spatial_split(eda_table(spark, sf_dir), "district_id", 2).join(names, "district_id", "left")
    codes = prep.fit_ordinal(e.where(F.col("split") == "train"), "n_name")
    return prep.apply_ordinal(e, "n_name", codes, "district_code").select("candidate_id", "district_code")


@query(
    "group_folds",
    "D6",
    "WITH RECURSIVE" + EDA_SQL.removeprefix("WITH") + """,
g AS (SELECT district_id, n, row_number() OVER (ORDER BY n DESC, district_id) AS i FROM (SELECT district_id, count(*) AS n FROM eda GROUP BY district_id)),
r AS (
  SELECT CAST(0 AS BIGINT) AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, CAST(NULL AS INTEGER) AS fold, CAST(0 AS BIGINT) AS n
  UNION ALL
  SELECT g.i, list_transform(r.load, lambda x, j: x + CASE WHEN j = list_position(r.load, list_min(r.load)) THEN g.n ELSE 0 END),
         CAST(list_position(r.load, list_min(r.load)) - 1 AS INTEGER), g.n
  FROM r JOIN g ON g.i = r.i + 1)
SELECT fold, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS groups FROM r WHERE i > 0 GROUP BY fold""",
)
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = eda_table(spark, sf_dir)
    folds = prep.group_folds(e, "district_id", 5)
    return e.join(folds, "district_id", "left").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("district_id").alias("groups"))


@query(
    "stratified_folds",
    "D7",
    SCORED_SQL + """
SELECT label, CAST((row_number() OVER (PARTITION BY label ORDER BY """ + hash_order_sql("candidate_id") + """) - 1) % 5
                   AS INTEGER) AS fold, CAST(count(*) OVER () AS BIGINT) AS total, candidate_id
FROM ev""",
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).where(F.col("prob").isNotNull() & F.col("label").isNotNull())
    f = prep.stratified_folds(s, "label", "candidate_id", 5)
    total = s.agg(F.count(F.lit(1))).scalar()
    return f.select("label", "fold", total.alias("total"), "candidate_id")


AUC_SQL = """
SELECT round((sum(r) FILTER (WHERE label = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc_roc,
       CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg
FROM (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS r,
             count(*) FILTER (WHERE label = 1) OVER () AS n1, count(*) FILTER (WHERE label = 0) OVER () AS n0
      FROM ev) t GROUP BY n1, n0"""


@query("roc_auc", "M7", SCORED_SQL + AUC_SQL)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ev.auc(scored(spark, sf_dir))
    return a.select(F.round("auc_roc", 6).alias("auc_roc"), "n_pos", "n_neg")


@query(
    "confusion_metrics",
    "M8 M9 M11 M12",
    SCORED_SQL + """,
c AS (SELECT count(*) FILTER (WHERE label = 0 AND prob < 0.74) AS tn, count(*) FILTER (WHERE label = 0 AND prob >= 0.74) AS fp,
             count(*) FILTER (WHERE label = 1 AND prob < 0.74) AS fn, count(*) FILTER (WHERE label = 1 AND prob >= 0.74) AS tp,
             count(*) AS n_test, avg(label) AS rt, avg(CASE WHEN prob >= 0.74 THEN 1 ELSE 0 END) AS rp FROM ev),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM c)
SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
       CAST(n_test AS BIGINT) AS n_test, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1,
       round(rt, 6) AS positive_rate_test, round(rp, 6) AS positive_rate_pred,
       CASE WHEN rp >= 0.95 THEN 'all_positive' WHEN rp <= 0.05 THEN 'all_negative' END AS degenerate
FROM m""",
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ev.confusion(scored(spark, sf_dir), THRESHOLD)
    r = ["precision", "recall", "f1", "positive_rate_test", "positive_rate_pred"]
    return c.select("tn", "fp", "fn", "tp", "n_test", *[F.round(x, 6).alias(x) for x in r], "degenerate")


@query(
    "class_report",
    "M10",
    SCORED_SQL + """,
c AS (SELECT count(*) FILTER (WHERE label = 0 AND prob < 0.74) AS tn, count(*) FILTER (WHERE label = 0 AND prob >= 0.74) AS fp,
             count(*) FILTER (WHERE label = 1 AND prob < 0.74) AS fn, count(*) FILTER (WHERE label = 1 AND prob >= 0.74) AS tp
      FROM ev),
per AS (SELECT '0' AS label, coalesce(tn / nullif(tn + fn, 0), 0.0) AS p, coalesce(tn / nullif(tn + fp, 0), 0.0) AS r,
               tn + fp AS support FROM c
        UNION ALL
        SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0.0), coalesce(tp / nullif(tp + fn, 0), 0.0), tp + fn FROM c),
per2 AS (SELECT label, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1, support FROM per)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / (tp + tn + fp + fn), 6), CAST(tp + tn + fp + fn AS BIGINT) FROM c
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per2""",
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ev.class_report(scored(spark, sf_dir), THRESHOLD)
    return r.select("label", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")], "support")


@query(
    "threshold_sweep",
    "M13 M15",
    SCORED_SQL + """,
th AS (SELECT i, CASE WHEN i = 50 THEN 0.75 ELSE CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE) + CAST(0.25 AS DOUBLE) END AS threshold FROM range(51) t(i)),
m AS (SELECT th.i, th.threshold, count(*) FILTER (WHERE ev.label = 1 AND ev.prob >= th.threshold) AS tp,
             count(*) FILTER (WHERE ev.label = 0 AND ev.prob >= th.threshold) AS fp,
             (SELECT count(*) FROM ev WHERE label = 1) AS pos
      FROM th, ev GROUP BY th.i, th.threshold),
m2 AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(pos, 0), 0.0) AS recall FROM m),
m3 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m2)
SELECT CAST(i AS INTEGER) AS i, round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       row_number() OVER (ORDER BY f1 DESC, i) = 1 AS is_best, threshold <= 0.27 OR threshold >= 0.73 AS at_boundary
FROM m3""",
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev.threshold_sweep(scored(spark, sf_dir), "f1")
    return s.select("i", F.round("threshold", 6).alias("threshold"), "tp", "fp",
                    *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")], "is_best", "at_boundary")


@query(
    "acceptance_gate",
    "M16 M17",
    SCORED_SQL + """,
a AS (""" + AUC_SQL.strip() + """),
c AS (SELECT count(*) FILTER (WHERE label = 1 AND prob >= 0.74) AS tp, count(*) FILTER (WHERE label = 0 AND prob >= 0.74) AS fp,
             count(*) FILTER (WHERE label = 1 AND prob < 0.74) AS fn FROM ev),
m AS (SELECT coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c),
g AS (SELECT a.auc_roc, m.p, coalesce(2 * m.p * m.r / nullif(m.p + m.r, 0), 0.0) AS f1 FROM a, m)
SELECT auc_roc, CASE WHEN auc_roc >= 0.80 THEN 'good' WHEN auc_roc >= 0.70 THEN 'acceptable'
                     WHEN auc_roc >= 0.60 THEN 'weak' ELSE 'near_random' END AS auc_tier,
       round(f1, 6) AS f1, round(p, 6) AS precision, f1 >= 0.70 AND auc_roc >= 0.75 AND p >= 0.80 AS accepted
FROM g""",
)
def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    a = ev.auc(s).select(F.round("auc_roc", 6).alias("auc_roc"))
    c = ev.confusion(s, THRESHOLD).select("f1", "precision")
    auc_v = a.first()["auc_roc"]  # scalar read of a one-row result
    return c.select(F.lit(auc_v).alias("auc_roc"), ev.auc_tier(F.lit(auc_v)).alias("auc_tier"),
                    F.round("f1", 6).alias("f1"), F.round("precision", 6).alias("precision"),
                    ev.acceptance_gate(F.col("f1"), F.lit(auc_v), F.col("precision")).alias("accepted"))


@query(
    "class_weights",
    "M18",
    SCORED_SQL + """
SELECT label, CAST(count(*) AS BIGINT) AS n_class, round((SELECT count(*) FROM ev) / (2.0 * count(*)), 6) AS weight
FROM ev GROUP BY label""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).where(F.col("prob").isNotNull() & F.col("label").isNotNull())
    w = ev.class_weights(s, "label")
    return w.select("label", "n_class", F.round("weight", 6).alias("weight"))


@query(
    "fold_auc_stats",
    "M4 A25",
    SCORED_SQL + """,
f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY """ + hash_order_sql("candidate_id") + """) - 1) % 5
              AS fold FROM ev),
r AS (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY prob)
                            + (count(*) OVER (PARTITION BY fold, prob) - 1) / 2.0 AS rk FROM f),
a AS (SELECT fold, (sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
                   / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS auc FROM r GROUP BY fold)
SELECT CAST(count(*) AS BIGINT) AS n_folds, round(avg(auc), 6) AS cv_auc_mean, round(stddev_pop(auc), 6) AS cv_auc_std FROM a""",
)
def fold_auc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-fold AUC (stratified folds of the scored rows), mean and population std."""
    s = scored(spark, sf_dir).where(F.col("prob").isNotNull() & F.col("label").isNotNull())
    f = prep.stratified_folds(s, "label", "candidate_id", 5)
    a = ev.auc(f, groups=["fold"])
    return a.agg(F.count(F.lit(1)).alias("n_folds"), F.round(F.avg("auc_roc"), 6).alias("cv_auc_mean"),
                 F.round(F.stddev_pop("auc_roc"), 6).alias("cv_auc_std"))
