"""Stage 4 queries: profiling of the labelled zone table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import profile, ranking
from ..session import cached
from .registry import query
from .zones_q import ZONE_FEATURES_SQL, scored_zones
from ..sources.tables import with_views

EDA_FEATURES = [
    "population_density", "nse_ab_pct", "walkability_score", "dist_nearest_road_m", "waste_per_capita_kg",
    "land_use_encoded", "dist_nearest_recycling_m", "recycling_density_1km", "accessibility_composite",
    "recycling_deficit", "coverage_gap_index", "lat", "lon",
]
NUMERIC_EDA = [f for f in EDA_FEATURES if f != "land_use_encoded"]
TARGET = "is_optimal"

# the labelled zone table: L3 deterministic Bernoulli label, u < (p - 0.7) / 0.3
EDA_SQL = with_views(ZONE_FEATURES_SQL) + """,
eda AS (SELECT candidate_id, district_id, population_density, nse_ab_pct, walkability_score, dist_nearest_road_m,
               waste_per_capita_kg, land_use_encoded, dist_nearest_recycling_m, recycling_density_1km,
               accessibility_composite, recycling_deficit, coverage_gap_index, lat, lon, prob_optimal,
               CAST(u < (prob_optimal - 0.7) / 0.3 AS INTEGER) AS is_optimal
        FROM scored)"""


def eda_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_zones(spark, sf_dir, stored=True)
    return s.select("candidate_id", "district_id", *EDA_FEATURES, "prob_optimal",
                    (F.col("u") < (F.col("prob_optimal") - 0.7) / 0.3).cast("int").alias(TARGET))


def _long_sql(features: list[str], ids: list[str] | None = None, src: str = "eda") -> str:
    ids = ids or []
    sel = ", ".join(ids + [f"CAST({f} AS DOUBLE) AS {f}" for f in features])
    return f"(UNPIVOT (SELECT {sel} FROM {src}) ON {', '.join(features)} INTO NAME feature VALUE value)"


def _r6(cols: list[str]) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


@query(
    "describe",
    "A6",
    EDA_SQL + f"""
SELECT feature, CAST(count(value) AS BIGINT) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(round(quantile_cont(value, 0.25), 9), 6) AS p25, round(round(quantile_cont(value, 0.5), 9), 6) AS p50,
       round(round(quantile_cont(value, 0.75), 9), 6) AS p75, round(max(value), 6) AS max
FROM {_long_sql(EDA_FEATURES)} GROUP BY feature""",
)
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = profile.describe(eda_table(spark, sf_dir), EDA_FEATURES)
    d = d.withColumns({c: F.round(c, 9) for c in ("p25", "p50", "p75")})  # interpolation noise must not decide a tie
    return d.select("feature", "count", *_r6(["mean", "std", "min", "p25", "p50", "p75", "max"]))


@query(
    "null_counts",
    "A7",
    EDA_SQL + "\nSELECT feature, CAST(n_null AS BIGINT) AS n_null, round(n_null / n, 6) AS pct_null FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) - count({f}) AS n_null, count(*) AS n FROM eda" for f in EDA_FEATURES + [TARGET]
    ) + ") t",
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_counts(eda_table(spark, sf_dir), EDA_FEATURES + [TARGET])


@query(
    "distinct_counts",
    "A8",
    EDA_SQL + f"\nSELECT feature, CAST(count(DISTINCT value) AS BIGINT) AS n_distinct FROM {_long_sql(EDA_FEATURES)} GROUP BY feature",
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_counts(eda_table(spark, sf_dir), EDA_FEATURES)


@query(
    "value_counts",
    "A2 A3",
    EDA_SQL + """
SELECT walkability_score, CAST(count(*) AS BIGINT) AS count, round(count(*) / (SELECT count(*) FROM eda), 6) AS share
FROM eda GROUP BY walkability_score""",
)
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per walkability value; the null group (every 17th zone) is kept."""
    return profile.value_counts(eda_table(spark, sf_dir), "walkability_score")


@query(
    "class_crosstab",
    "A4 A3",
    EDA_SQL + """
SELECT district_id, CAST(count(*) FILTER (WHERE is_optimal = 0) AS BIGINT) AS n_0,
       CAST(count(*) FILTER (WHERE is_optimal = 1) AS BIGINT) AS n_1
FROM eda GROUP BY district_id""",
)
def class_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.crosstab(eda_table(spark, sf_dir), "district_id", TARGET)


DISTRICT_MEDIANS = ["population_density", "walkability_score", "dist_nearest_recycling_m", "coverage_gap_index",
                    "nse_ab_pct"]


@query(
    "district_profile",
    "A5",
    EDA_SQL + """
SELECT district_id, CAST(count(candidate_id) AS BIGINT) AS n_zonas, round(avg(is_optimal), 3) AS pct_optimas,
       round(median(population_density), 3) AS pop_density_med, round(median(walkability_score), 3) AS walkability_med,
       round(median(dist_nearest_recycling_m), 3) AS dist_recycling_med,
       round(median(coverage_gap_index), 3) AS coverage_gap_med, round(median(nse_ab_pct), 3) AS nse_ab_med
FROM eda GROUP BY district_id""",
)
def district_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named multi-aggregate per district: count, mean target, five exact medians."""
    e = eda_table(spark, sf_dir)
    base = e.groupBy("district_id").agg(F.count("candidate_id").alias("n_zonas"),
                                        F.round(F.avg(TARGET), 3).alias("pct_optimas"))
    lf = profile.long_form(e, DISTRICT_MEDIANS, ["district_id"])
    med = ranking.quantiles(lf, ["district_id", "feature"], "value", [0.5], ["med"])
    names = {"population_density": "pop_density_med", "walkability_score": "walkability_med",
             "dist_nearest_recycling_m": "dist_recycling_med", "coverage_gap_index": "coverage_gap_med",
             "nse_ab_pct": "nse_ab_med"}
    wide = med.groupBy("district_id").agg(
        *[F.round(F.max(F.when(F.col("feature") == k, F.col("med"))), 3).alias(v) for k, v in names.items()])
    return base.join(wide, "district_id", "left")


@query(
    "target_pearson",
    "A10 A15 K2",
    EDA_SQL + f""",
lf AS (SELECT feature, value, CAST(is_optimal AS DOUBLE) AS t FROM {_long_sql(EDA_FEATURES, ['is_optimal'])} WHERE is_optimal IS NOT NULL),
agg AS (SELECT feature, count(*) AS n_valid, count(DISTINCT value) AS ux, min(t) AS tmin, max(t) AS tmax,
               covar_pop(value, t) AS c, var_pop(value) AS vx, var_pop(t) AS vt,
               avg(value) FILTER (WHERE t = 0) AS m0, avg(value) FILTER (WHERE t = 1) AS m1
        FROM lf GROUP BY feature)
SELECT feature,
       round(CASE WHEN n_valid >= 3 AND ux >= 2 AND tmin <> tmax AND vx * vt > 0 THEN c / sqrt(vx * vt) END, 6) AS pearson_vs_target,
       round(abs(CASE WHEN n_valid >= 3 AND ux >= 2 AND tmin <> tmax AND vx * vt > 0 THEN c / sqrt(vx * vt) END), 6) AS abs_pearson,
       CAST(n_valid AS BIGINT) AS n_valid, round(m0, 6) AS mean_when_target_0, round(m1, 6) AS mean_when_target_1
FROM agg ORDER BY abs_pearson DESC NULLS LAST""",
)
def target_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = profile.target_correlations(eda_table(spark, sf_dir), EDA_FEATURES, TARGET, spearman=False)
    return c.select("feature", *_r6(["pearson_vs_target", "abs_pearson"]), "n_valid",
                    *_r6(["mean_when_target_0", "mean_when_target_1"])).orderBy(F.desc_nulls_last("abs_pearson"))


@query(
    "target_spearman",
    "A11",
    EDA_SQL + f""",
lf AS (SELECT feature, value, CAST(is_optimal AS DOUBLE) AS t FROM {_long_sql(EDA_FEATURES, ['is_optimal'])} WHERE is_optimal IS NOT NULL),
rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value)
                        + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY feature ORDER BY t)
                        + (count(*) OVER (PARTITION BY feature, t) - 1) / 2.0 AS rt,
              value, t FROM lf),
agg AS (SELECT feature, count(*) AS n, count(DISTINCT value) AS ux, min(t) AS tmin, max(t) AS tmax,
               covar_pop(rx, rt) AS c, var_pop(rx) AS vx, var_pop(rt) AS vt FROM rk GROUP BY feature)
SELECT feature, round(CASE WHEN n >= 3 AND ux >= 2 AND tmin <> tmax AND vx * vt > 0 THEN c / sqrt(vx * vt) END, 6)
       AS spearman_vs_target FROM agg""",
)
def target_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = profile.target_correlations(eda_table(spark, sf_dir), EDA_FEATURES, TARGET)
    return c.select("feature", F.round("spearman_vs_target", 6).alias("spearman_vs_target"))


def _pairs_sql(features: list[str]) -> str:
    parts = []
    for i, a in enumerate(features):
        for b in features[i + 1:]:
            parts.append(
                f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n, covar_pop(x, y) AS c, var_pop(x) AS vx,"
                f" var_pop(y) AS vy FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM eda"
                f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL) s"
            )
    return " UNION ALL ".join(parts)


@query(
    "corr_matrix_pairs",
    "A12 A13",
    EDA_SQL + f""",
fpairs AS ({_pairs_sql(EDA_FEATURES)}),
r AS (SELECT feature_a, feature_b, CASE WHEN vx * vy > 0 THEN c / sqrt(vx * vy) END AS r FROM fpairs)
SELECT feature_a, feature_b, round(r, 6) AS r FROM r WHERE abs(r) >= 0.7""",
)
def corr_matrix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = profile.corr_pairs(eda_table(spark, sf_dir), EDA_FEATURES)
    return profile.redundant_pairs(pairs).select("feature_a", "feature_b", F.round("r", 6).alias("r"))


@query(
    "corr_matrix",
    "A12",
    EDA_SQL + f""",
fpairs AS ({_pairs_sql(EDA_FEATURES)})
SELECT feature_a, feature_b, CAST(n AS BIGINT) AS n, round(CASE WHEN vx * vy > 0 THEN c / sqrt(vx * vy) END, 6) AS r FROM fpairs""",
)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of features, not only the redundant ones."""
    pairs = profile.corr_pairs(eda_table(spark, sf_dir), EDA_FEATURES)
    return pairs.select("feature_a", "feature_b", "n", F.round("r", 6).alias("r"))


@query(
    "weak_features",
    "A14 F20",
    EDA_SQL + f""",
lf AS (SELECT feature, value, CAST(is_optimal AS DOUBLE) AS t FROM {_long_sql(EDA_FEATURES, ['is_optimal'])} WHERE is_optimal IS NOT NULL),
agg AS (SELECT feature, covar_pop(value, t) AS c, var_pop(value) AS vx, var_pop(t) AS vt FROM lf GROUP BY feature),
r AS (SELECT feature, CASE WHEN vx * vt > 0 THEN c / sqrt(vx * vt) END AS r FROM agg)
SELECT feature, round(r, 6) AS r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM r WHERE abs(r) < 0.05""",
)
def weak_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = profile.target_correlations(eda_table(spark, sf_dir), EDA_FEATURES, TARGET, spearman=False)
    return c.where(F.col("abs_pearson") < profile.WEAK_ABS_R).select(
        "feature", F.round("pearson_vs_target", 6).alias("r"), fx.direction("pearson_vs_target").alias("direction"))


@query(
    "iqr_outliers",
    "A16",
    EDA_SQL + f""",
lf AS (SELECT feature, value FROM {_long_sql(NUMERIC_EDA)}),
q AS (SELECT feature, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.75), 9) AS q3 FROM lf GROUP BY feature),
f AS (SELECT feature, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT lf.feature, CAST(count(*) FILTER (WHERE value < lo OR value > hi) AS BIGINT) AS n_outliers,
       round(count(*) FILTER (WHERE value < lo OR value > hi) / count(*) * 100, 2) AS pct_outliers,
       round(min(lo), 3) AS lower_fence, round(min(hi), 3) AS upper_fence
FROM lf JOIN f ON lf.feature = f.feature GROUP BY lf.feature""",
)
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.iqr_outliers(eda_table(spark, sf_dir), NUMERIC_EDA)


BOX_FEATURES = 12


@query(
    "class_histogram",
    "A17",
    EDA_SQL + f""",
lf AS (SELECT feature, value, is_optimal FROM {_long_sql(NUMERIC_EDA, ['is_optimal'])} WHERE is_optimal IS NOT NULL),
rg AS (SELECT feature, is_optimal, min(value) AS lo, max(value) AS hi, count(*) AS n FROM lf GROUP BY feature, is_optimal),
b AS (SELECT lf.feature, lf.is_optimal, n,
             CASE WHEN hi > lo THEN (hi - lo) / 30 ELSE 1.0 / 30 END AS width,
             CAST(least(floor((value - CASE WHEN hi > lo THEN lo ELSE lo - 0.5 END)
                              / CASE WHEN hi > lo THEN (hi - lo) / 30 ELSE 1.0 / 30 END), 29) AS INTEGER) AS bin
      FROM lf JOIN rg ON lf.feature = rg.feature AND lf.is_optimal = rg.is_optimal)
SELECT feature, is_optimal, bin, CAST(count(*) AS BIGINT) AS count, round(count(*) / (min(n) * min(width)), 6) AS density
FROM b GROUP BY feature, is_optimal, bin""",
)
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.class_histogram(eda_table(spark, sf_dir), NUMERIC_EDA, TARGET)


@query(
    "box_stats",
    "A18",
    EDA_SQL + f""",
every AS (SELECT feature, value, is_optimal FROM {_long_sql(NUMERIC_EDA, ['is_optimal'])} WHERE is_optimal IS NOT NULL),
strongest AS (SELECT feature FROM (SELECT feature, CASE WHEN var_pop(value) * var_pop(is_optimal) > 0
                THEN round(abs(covar_pop(value, is_optimal) / sqrt(var_pop(value) * var_pop(is_optimal))), 6) END AS r FROM every GROUP BY feature)
              ORDER BY r DESC NULLS LAST, feature LIMIT {BOX_FEATURES}),
lf AS (SELECT * FROM every WHERE feature IN (SELECT feature FROM strongest)),
q AS (SELECT feature, is_optimal, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS median,
             round(quantile_cont(value, 0.75), 9) AS q3 FROM lf GROUP BY feature, is_optimal),
j AS (SELECT lf.*, q.q1, q.median, q.q3,
             lf.value >= q.q1 - 1.5 * (q.q3 - q.q1) AND lf.value <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM lf JOIN q ON lf.feature = q.feature AND lf.is_optimal = q.is_optimal)
SELECT feature, is_optimal, round(min(q1), 6) AS q1, round(min(median), 6) AS median, round(min(q3), 6) AS q3,
       round(min(value) FILTER (WHERE inside), 6) AS whisker_lo, round(max(value) FILTER (WHERE inside), 6) AS whisker_hi,
       CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS n_fliers
FROM j GROUP BY feature, is_optimal""",
)
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = eda_table(spark, sf_dir)
    ranked = profile.target_correlations(e, NUMERIC_EDA, TARGET, spearman=False)
    top = ranked.orderBy(F.desc_nulls_last(F.round("abs_pearson", 6)), "feature").limit(BOX_FEATURES)
    b = profile.box_stats(e, [r["feature"] for r in top.collect()], TARGET)
    return b.select("feature", TARGET, *_r6(["q1", "median", "q3", "whisker_lo", "whisker_hi"]), "n_fliers")


@query(
    "balance_flags",
    "A9 A21",
    EDA_SQL + """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(is_optimal), 6) AS positive_rate,
       avg(is_optimal) < 0.15 OR avg(is_optimal) > 0.75 AS severe_imbalance,
       avg(is_optimal) >= 0.30 AND avg(is_optimal) <= 0.70 AS balance_acceptable
FROM eda""",
)
def balance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.balance_flags(eda_table(spark, sf_dir), TARGET)


@query(
    "eda_findings",
    "A22 A13 A14 K3 F20",
    EDA_SQL + f""",
lf AS (SELECT feature, value, CAST(is_optimal AS DOUBLE) AS t FROM {_long_sql(EDA_FEATURES, ['is_optimal'])} WHERE is_optimal IS NOT NULL),
agg AS (SELECT feature, covar_pop(value, t) AS c, var_pop(value) AS vx, var_pop(t) AS vt FROM lf GROUP BY feature),
r AS (SELECT feature, CASE WHEN vx * vt > 0 THEN c / sqrt(vx * vt) END AS r FROM agg),
top AS (SELECT feature, r FROM r WHERE r IS NOT NULL ORDER BY abs(r) DESC, feature LIMIT 5),
fpairs AS ({_pairs_sql(EDA_FEATURES)}),
red AS (SELECT count(*) AS n FROM fpairs WHERE vx * vy > 0 AND abs(c / sqrt(vx * vy)) >= 0.7),
weak AS (SELECT count(*) AS n FROM r WHERE abs(r) < 0.05)
SELECT 'top_correlation' AS kind, feature, round(r, 6) AS value,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS verdict FROM top
UNION ALL SELECT 'redundant_pairs', NULL, CAST(n AS DOUBLE), CASE WHEN n = 0 THEN 'ok' ELSE 'review' END FROM red
UNION ALL SELECT 'weak_features', NULL, CAST(n AS DOUBLE), CASE WHEN n = 0 THEN 'ok' ELSE 'review' END FROM weak
UNION ALL SELECT 'expected_signal', NULL, round((SELECT max(abs(r)) FROM r), 6),
       CASE WHEN (SELECT max(abs(r)) FROM r) > 0.2 THEN 'signal_present' ELSE 'weak_signal' END
UNION ALL SELECT 'balance', NULL, round(avg(is_optimal), 6),
       CASE WHEN avg(is_optimal) >= 0.30 AND avg(is_optimal) <= 0.70 THEN 'acceptable' ELSE 'imbalanced' END FROM eda""",
)
def eda_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic conclusions as a findings table (kind, feature, value, verdict)."""
    e = eda_table(spark, sf_dir)
    corr = profile.target_correlations(e, EDA_FEATURES, TARGET, spearman=False).select(
        "feature", F.col("pearson_vs_target").alias("r"))
    corr = cached(corr)
    pairs = profile.corr_pairs(e, EDA_FEATURES)
    top = corr.where(F.col("r").isNotNull()).orderBy(F.abs("r").desc(), "feature").limit(5).select(
        F.lit("top_correlation").alias("kind"), "feature", F.round("r", 6).alias("value"),
        fx.direction("r").alias("verdict"))

    def count_row(kind: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("feature"),
            F.col("n").cast("double").alias("value"),
            F.when(F.col("n") == 0, "ok").otherwise("review").alias("verdict"))

    red = count_row("redundant_pairs", pairs.where(F.abs("r") >= profile.REDUNDANT_ABS_R))
    weak = count_row("weak_features", corr.where(F.abs("r") < profile.WEAK_ABS_R))
    sig = corr.agg(F.max(F.abs("r")).alias("m")).select(
        F.lit("expected_signal").alias("kind"), F.lit(None).cast("string").alias("feature"),
        F.round("m", 6).alias("value"),
        F.when(F.col("m") > profile.SIGNAL_ABS_R, "signal_present").otherwise("weak_signal").alias("verdict"))
    bal = e.agg(F.avg(TARGET).alias("p")).select(
        F.lit("balance").alias("kind"), F.lit(None).cast("string").alias("feature"), F.round("p", 6).alias("value"),
        F.when((F.col("p") >= profile.BALANCE_OK_LO) & (F.col("p") <= profile.BALANCE_OK_HI), "acceptable")
        .otherwise("imbalanced").alias("verdict"))
    return top.unionByName(red).unionByName(weak).unionByName(sig).unionByName(bal)
