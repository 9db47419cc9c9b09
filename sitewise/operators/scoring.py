"""Zone feature table and the model-free suitability score.

``zone_features`` is the spatial half (J4 nearest point, J5 points in
500 m); ``score_zones`` applies the derived features (F3, F5, F6), the
noise-free logit and sigmoid (F14, F15), rounding (F17) and the
recommendation flag on the unrounded value (M6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from . import pyramid, spatial

# fixed values: radius of the existing-points count, label radius, flag cut
COUNT_RADIUS_KM = 0.5
LABEL_RADIUS_KM = 0.3
RECOMMEND_THRESHOLD = 0.74


def zone_features(zones: DataFrame, points: DataFrame, skew_rows: int | None = spatial.DEFAULT_SKEW_ROWS) -> DataFrame:
    """Nearest-point distance (m) and strict 500 m point count per zone.

    Both come from one join, unless locations crowd: then the counts come from sums of
    cells, and the nearest point is looked for within a radius of its own.
    """
    if pyramid.crowded(spatial.point_locations(points), COUNT_RADIUS_KM / pyramid.REACH):
        # the nearest point first: its rounds are kept, while counts would be made anew by each of them
        z = spatial.nearest(zones, points, dist_col="nearest_km", id_col=None, skew_rows=skew_rows)
        z = spatial.count_within(z, points, COUNT_RADIUS_KM, out="recycling_density_1km")
        return z.withColumn("dist_nearest_recycling_m", F.col("nearest_km") * F.lit(1000.0)).drop("nearest_km")
    n500 = F.coalesce(F.sum(F.when(F.col("dist_km") < F.lit(COUNT_RADIUS_KM), F.col("weight"))), F.lit(0))
    z = spatial.nearest(zones, points, dist_col="nearest_km", id_col=None, skew_rows=skew_rows,
                        extra_aggs=[n500.alias("recycling_density_1km")], min_r0_km=COUNT_RADIUS_KM)
    return z.withColumn("dist_nearest_recycling_m", F.col("nearest_km") * F.lit(1000.0)).drop("nearest_km")


def derive(df: DataFrame) -> DataFrame:
    """F3, F4, F5, F6 on a zone feature table."""
    return fx.with_derived(df, refresh=True)


def score_zones(df: DataFrame, threshold: float = RECOMMEND_THRESHOLD) -> DataFrame:
    """F14 + F15: probability, 4-digit score, flag on the unrounded probability."""
    prob = fx.sigmoid(fx.suitability_logit())
    return df.withColumn("prob_optimal", prob).withColumns(
        {
            "suitability_score": fx.round_half_up("prob_optimal", 4),
            "is_recommended": F.col("prob_optimal") >= F.lit(threshold),
        }
    )
