"""Contract of the zone table: feature lists, explicit schema, ``conform``.

Fixed values (they must equal the studied pipeline's contract for the
feature matrix to line up): feature names, their group order, the one
categorical column, the target and the group column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: feature contract -------------------------------------
DEMOGRAPHIC_FEATURES = [
    "population_density",
    "num_households",
    "nse_ab_pct",
    "nse_c_pct",
    "nse_de_pct",
    "urbanization_rate",
]
GEOSPATIAL_FEATURES = [
    "dist_nearest_road_m",
    "walkability_score",
    "poi_commercial_500m",
    "poi_educational_500m",
    "poi_parks_500m",
    "land_use_encoded",
    "area_m2",
]
OPERATIONAL_FEATURES = [
    "dist_nearest_recycling_m",
    "recycling_density_1km",
    "waste_per_capita_kg",
    "coverage_gap_index",
]
ENGINEERED_FEATURES = [
    "accessibility_composite",
    "nse_high_ratio",
    "recycling_deficit",
]
CATEGORICAL_FEATURES = ["land_use_encoded"]
TARGET_COLUMN = "is_optimal"
GROUP_COLUMN = "district_id"
SHAP_TOP_N = 5
CV_N_SPLITS = 5
RANDOM_STATE = 42
# -------------------------------------------------------------------------

ALL_FEATURES = DEMOGRAPHIC_FEATURES + GEOSPATIAL_FEATURES + OPERATIONAL_FEATURES + ENGINEERED_FEATURES
NUMERIC_FEATURES = [f for f in ALL_FEATURES if f not in CATEGORICAL_FEATURES]
# model input order: numeric block first, then the categorical one
MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES

_INT_FEATURES = {
    "num_households",
    "poi_commercial_500m",
    "poi_educational_500m",
    "poi_parks_500m",
    "land_use_encoded",
    "recycling_density_1km",
    "recycling_deficit",
}

# 17 required request fields + 3 optional engineered ones (nullable)
ZONE = T.StructType(
    [
        T.StructField(f, T.LongType() if f in _INT_FEATURES else T.DoubleType(), True)
        for f in ALL_FEATURES
    ]
)

# ---- fixed values: trace and location columns of the datasets ----------------
TRACE_COLUMNS = [
    "candidate_id",
    "dataset_version",
    "label_version",
    "label_status",
    "is_suitable",
    "candidate_origin",
    "source_dataset",
    "evidence_summary",
    "label_reason",
    "review_notes",
]
LOCATION_COLUMNS = [
    "district_id",
    "district",
    "latitude",
    "longitude",
    "centroid_lat",
    "centroid_lon",
    "geometry_quality",
]
# -------------------------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns, read from the schema (no scan)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def unique_existing(df: DataFrame, cols: list[str]) -> list[str]:
    """Ordered, de-duplicated, only columns that exist."""
    have = set(df.columns)
    return [c for c in dict.fromkeys(cols) if c in have]


def add_missing(df: DataFrame, schema: T.StructType = ZONE) -> DataFrame:
    """Add every contract column that is absent as a typed null."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def canonical_order(df: DataFrame, ordered: list[str]) -> DataFrame:
    """P5: known columns first in contract order, the remainder after them."""
    head = unique_existing(df, ordered)
    rest = [c for c in df.columns if c not in set(head)]
    return df.select(*head, *rest)


def cast_contract(df: DataFrame, schema: T.StructType = ZONE) -> DataFrame:
    """Cast the contract columns present to their declared type."""
    types = {f.name: f.dataType for f in schema.fields}
    return df.withColumns({c: F.col(c).cast(types[c]) for c in df.columns if c in types})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise NaN to NULL in double columns (pandas missing marker)."""
    dbl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in dbl}) if dbl else df
