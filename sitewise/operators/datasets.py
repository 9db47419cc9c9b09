"""Dataset assembly (P16, P17), labels (L1-L3), sampling and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import with_derived
from ..schema import ALL_FEATURES, LOCATION_COLUMNS, RANDOM_STATE, TRACE_COLUMNS, add_missing, canonical_order
from . import ranking, selection

# ---- fixed values: dataset versions, trace texts, district rule -------------
REAL_DATASET_VERSION = "real-candidates-v0.3"
SIMULATED_DATASET_VERSION = "simulated-training-v0.3"
LABEL_VERSION = "is-suitable-v0"
SIMULATED_LABEL_VERSION = "simulated-is-suitable-v0.3"
REAL_ID_FORMAT = "ECO-REAL-V03-%04d"
SIM_ID_FORMAT = "ECO-SIM-V03-%04d"
STATUS_UNKNOWN = "desconocido"
STATUS_SIMULATED = "etiquetado_simulado"
ORIGIN_LEGACY_POSITIVE = "legacy_positive_existing_point"
ORIGIN_LEGACY_OTHER = "legacy_unobserved_cell_or_negative"
ORIGIN_SIMULATED = "simulated_candidate_cell"
GEOMETRY_OK = "centroid_legacy_available"
GEOMETRY_MISSING = "centroid_missing_review_required"
REAL_EVIDENCE = "Fila real heredada del dataset ML v1; conserva features como evidencia tecnica provisional."
REAL_REASON = "La etiqueta heredada no se adopta como is_suitable; requiere contrato probado y evidencia independiente."
REAL_NOTES = "No usar como dataset supervisado final de tesis; sirve para endpoints y auditoria tecnica provisional."
SIMULATED_EVIDENCE = "Registro simulado para desarrollo tecnico de entrenamiento y endpoints."
SIMULATED_REASON = "Etiqueta simulada derivada de suitability_score y tasa positiva controlada; no es evidencia real de tesis."
SIMULATED_NOTES = "Usar para desarrollo, pruebas y contratos de API; no reportar como resultado real."
SIMULATED_ORDER = [
    "candidate_id", "dataset_version", "label_version", "label_status", "is_suitable", "candidate_origin",
    "source_dataset", "district_id", "district_name", "zone_id",
]
SIMULATED_TAIL = ["is_optimal", "suitability_score", "evidence_summary", "label_reason", "review_notes"]
DISTRICT_SPLIT_LON = -77.055
DISTRICT_WEST = "Magdalena del Mar"
DISTRICT_EAST = "Miraflores"
NEGATIVE_SAMPLE = 40
POSITIVE_RATE_RANGE = (0.05, 0.80)
# ------------------------------------------------------------------------------


def hash_order(key: str, seed: int = RANDOM_STATE) -> list[Column]:
    """Repeatable pseudo-random order for keys of any type: the digest of seed and key."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.col(key)]


def hash_order_sql(key: str, seed: int = RANDOM_STATE) -> str:
    """SQL text of :func:`hash_order`."""
    return f"md5('{seed}:' || CAST({key} AS VARCHAR)), {key}"


def sample_exact(df: DataFrame, n: int, key: str, seed: int = RANDOM_STATE) -> DataFrame:
    """Exactly min(n, available) rows in a seeded, repeatable order.

    ``orderBy + limit`` plans as TakeOrderedAndProject: each partition keeps
    its n best, so only n·partitions rows move.
    """
    return df.orderBy(*hash_order(key, seed)).limit(n)


def balanced_set(labelled: DataFrame, label: str, key: str, n_neg: int = NEGATIVE_SAMPLE) -> DataFrame:
    """U4: all positives plus up to ``n_neg`` sampled negatives (U1 union by name)."""
    pos = labelled.where(F.col(label) == 1).withColumns({"centroid_lat": F.col("lat"), "centroid_lon": F.col("lon")})
    neg = sample_exact(labelled.where(F.col(label) == 0), n_neg, key)
    return pos.unionByName(neg, allowMissingColumns=True)


def assign_district(lon: str = "lon") -> Column:
    """Rule-based zone → district."""
    return F.when(F.col(lon) < F.lit(DISTRICT_SPLIT_LON), F.lit(DISTRICT_WEST)).otherwise(F.lit(DISTRICT_EAST))


def quantile_label(df: DataFrame, score: str, rate: float, out: str = "is_optimal") -> tuple[DataFrame, float | None]:
    """1 when score ≥ quantile(1 - rate) (linear interpolation).

    The cut-off is a scalar read (a few small jobs over counts), rounded to
    nine digits so that interpolation leaves equal scores on one side.
    """
    lo, hi = POSITIVE_RATE_RANGE
    if not lo <= rate <= hi:
        raise ValueError(f"positive_rate must be between {lo} and {hi}")
    found = selection.quantiles(df, [score], [1.0 - rate])[None, score].quantile(1.0 - rate)
    cutoff = None if found is None else round(found, 9)
    lab = F.coalesce(F.col(score) >= F.lit(cutoff), F.lit(False)).cast("int") if cutoff is not None else F.lit(0)
    return df.withColumn(out, lab), cutoff


def bernoulli_label(prob: str, u: str) -> Column:
    """L3, deterministic: hash-uniform < probability; missing → 0."""
    return F.coalesce(F.col(u) < F.col(prob), F.lit(False)).cast("int")


def real_candidates(balanced: DataFrame, legacy: str = "is_optimal", source: str = "balanced_training_set") -> DataFrame:
    """Auditable provisional dataset from a legacy-labelled table.

    The legacy label is kept as ``is_optimal_legacy`` and never adopted as
    ``is_suitable`` (trap 23); ids are consecutive in input order (positives
    first, then negatives, each by key).  Features that can be derived are filled
    in (F1), the district comes from the first of two columns that exists (P15),
    contract features that are absent become typed nulls (P4), and columns stand
    in contract order with the rest behind (P5).
    """
    named = next((c for c in ("Distrito", "district_name") if c in balanced.columns), None)
    df = with_derived(balanced, refresh=False).withColumn("district", F.col(named) if named else F.lit(""))
    df = df.withColumn("_ord", F.lit(1) - F.coalesce(F.col(legacy), F.lit(0)))
    df = ranking.row_numbers(df, ["_ord", "zone_key"], "_seq").drop("_ord")
    df = df.withColumns({"centroid_lat": F.coalesce("centroid_lat", "latitude"),
                         "centroid_lon": F.coalesce("centroid_lon", "longitude")})
    df = df.withColumns(
        {
            "candidate_id": F.format_string(REAL_ID_FORMAT, F.col("_seq")),
            "dataset_version": F.lit(REAL_DATASET_VERSION),
            "label_version": F.lit(LABEL_VERSION),
            "label_status": F.lit(STATUS_UNKNOWN),
            "is_suitable": F.lit(""),
            "is_optimal_legacy": F.col(legacy),
            "candidate_origin": F.when(F.coalesce(F.col(legacy), F.lit(0)) == 1, F.lit(ORIGIN_LEGACY_POSITIVE))
            .otherwise(F.lit(ORIGIN_LEGACY_OTHER)),
            "source_dataset": F.lit(source),
            "geometry_quality": F.when(F.col("centroid_lat").isNotNull() & F.col("centroid_lon").isNotNull(),
                                       F.lit(GEOMETRY_OK)).otherwise(F.lit(GEOMETRY_MISSING)),
            "evidence_summary": F.lit(REAL_EVIDENCE),
            "label_reason": F.lit(REAL_REASON),
            "review_notes": F.lit(REAL_NOTES),
        }
    ).drop(legacy, "_seq")
    return canonical_order(add_missing(df), TRACE_COLUMNS + LOCATION_COLUMNS + ALL_FEATURES)


def real_summary(real: DataFrame) -> DataFrame:
    """Counts, versions and flags of :func:`real_candidates`, one row."""
    return real.agg(
        F.max("dataset_version").alias("dataset_version"), F.count(F.lit(1)).alias("rows"),
        F.lit(len(real.columns)).cast("long").alias("columns"),
        F.count(F.when(F.col("centroid_lat").isNotNull() & F.col("centroid_lon").isNotNull(), 1)).alias("with_centroid"),
        F.lit(False).alias("training_allowed"))


def count_text(df: DataFrame, col: str) -> DataFrame:
    """Value counts of a low-cardinality column as one text ``value:count`` list, nulls first."""
    counts = df.groupBy(F.col(col).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("v", "n"))), lambda x: F.concat(F.coalesce(x["v"], F.lit("null")), F.lit(":"), x["n"].cast("string")))
    return counts.agg(F.array_join(listed, ",").alias(f"{col}_counts"))


def simulated_dataset(scored: DataFrame, rate: float, key: str, source: str = "scored_zones") -> tuple[DataFrame, float | None]:
    """Quantile-labelled training set with trace columns and sequential ids,
    in contract order with the rest behind."""
    lab, cutoff = quantile_label(scored, "suitability_score", rate)
    lab = ranking.row_numbers(lab, [key], "_seq")
    lab = lab.withColumns(
        {
            "candidate_id": F.format_string(SIM_ID_FORMAT, F.col("_seq")),
            "zone_id": F.col("_seq") - 1,
            "is_suitable": F.col("is_optimal"),
            "dataset_version": F.lit(SIMULATED_DATASET_VERSION),
            "label_version": F.lit(SIMULATED_LABEL_VERSION),
            "label_status": F.lit(STATUS_SIMULATED),
            "candidate_origin": F.lit(ORIGIN_SIMULATED),
            "source_dataset": F.lit(source),
            "evidence_summary": F.lit(SIMULATED_EVIDENCE),
            "label_reason": F.lit(SIMULATED_REASON),
            "review_notes": F.lit(SIMULATED_NOTES),
        }
    ).drop("_seq")
    return canonical_order(lab, SIMULATED_ORDER + ALL_FEATURES + SIMULATED_TAIL), cutoff
