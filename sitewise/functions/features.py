"""Scalar feature functions (F-series) as JVM-side column expressions.

All of them stay inside whole-stage codegen; none is a Python UDF.
Null handling follows pandas where it differs from SQL (see the traps in
SURVEY §2.13): clip keeps nulls, a comparison with a missing value is 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: formula constants of the suitability model ----------
ROAD_REF_M = 300.0          # accessibility: road distance normaliser
WALK_WEIGHT = 0.6           # accessibility: walkability weight
ROAD_WEIGHT = 0.4           # accessibility: road proximity weight
DEFICIT_RADIUS_M = 500.0    # recycling deficit: no point within this distance
LOGIT_DENSITY_REF = 25000.0
LOGIT_W_DENSITY = 2.0
LOGIT_W_ACCESS = 1.5
LOGIT_W_GAP = 1.2
LOGIT_W_NSE = 0.8
LOGIT_REC_REF = 5.0
LOGIT_W_REC = 1.0
SIGMOID_OFFSET = 0.2
# -------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """F16: clip to [lo, hi]; null stays null (unlike ``least(greatest())``)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def accessibility_composite(walk: Column | str = "walkability_score", road: Column | str = "dist_nearest_road_m") -> Column:
    """0.6·walkability + 0.4·(1 - clip(road/300, 0, 1))."""
    return F.lit(WALK_WEIGHT) * _c(walk) + F.lit(ROAD_WEIGHT) * (F.lit(1.0) - clip(_c(road) / F.lit(ROAD_REF_M), 0.0, 1.0))


def recycling_deficit(dist_m: Column | str = "dist_nearest_recycling_m") -> Column:
    """1 when the nearest point is ≥ 500 m away; a missing distance gives 0."""
    return F.coalesce(_c(dist_m) >= F.lit(DEFICIT_RADIUS_M), F.lit(False)).cast("int")


def potential_index(density: Column | str, kg: Column | str, pct: Column | str) -> Column:
    """F8: recycling potential = density · kg per capita · recyclable % / 100."""
    return _c(density) * _c(kg) * _c(pct) / F.lit(100.0)


def pct_to_rate(x: Column | str) -> Column:
    """percent → rate."""
    return _c(x) / F.lit(100.0)


def suitability_logit(
    density: Column | str = "population_density",
    access: Column | str = "accessibility_composite",
    gap: Column | str = "coverage_gap_index",
    nse: Column | str = "nse_high_ratio",
    rec: Column | str = "recycling_density_1km",
) -> Column:
    """noise-free suitability logit."""
    return (
        F.lit(LOGIT_W_DENSITY) * (_c(density) / F.lit(LOGIT_DENSITY_REF))
        + F.lit(LOGIT_W_ACCESS) * _c(access)
        + F.lit(LOGIT_W_GAP) * _c(gap)
        + F.lit(LOGIT_W_NSE) * _c(nse)
        - F.lit(LOGIT_W_REC) * clip(_c(rec).cast("double") / F.lit(LOGIT_REC_REF), 0.0, 1.0)
    )


def sigmoid(logit: Column | str) -> Column:
    """1 / (1 + exp(-logit + 0.2))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(SIGMOID_OFFSET) - _c(logit)))


def round_half_up(x: Column | str, n: int) -> Column:
    """F17 (Python ``round`` on scores, trap 3): Spark ``round`` is HALF_UP."""
    return F.round(_c(x), n)


def round_half_even(x: Column | str, n: int) -> Column:
    """F17 (NumPy rounding, trap 3): banker's rounding."""
    return F.bround(_c(x), n)


def direction(x: Column | str) -> Column:
    """'positive' when > 0 else 'negative' (zero is negative)."""
    return F.when(_c(x) > 0, F.lit("positive")).otherwise(F.lit("negative"))


def address_key(*parts: Column | str) -> Column:
    """comma-joined address; nulls are skipped."""
    return F.concat_ws(", ", *[_c(p) for p in parts])


# fixed values: accent folding for district-name normalisation
ACCENTED = "áéíóúüñàèìòùÁÉÍÓÚÜÑÀÈÌÒÙ"
PLAIN = "aeiouunaeiouAEIOUUNAEIOU"


def normalize_name(x: Column | str) -> Column:
    """trim, fold accents, lower-case, squeeze inner blanks."""
    return F.regexp_replace(F.lower(F.translate(F.trim(_c(x)), ACCENTED, PLAIN)), r"\s+", " ")


@dataclass(frozen=True)
class Derived:
    """How one feature follows from others; ``refreshed``: a stored value may be replaced."""

    output: str
    inputs: tuple[str, ...]
    value: Callable[[], Column]
    refreshed: bool


#: F2-F7, in an order in which inputs come before what is derived from them
DERIVED = (
    Derived("accessibility_composite", ("walkability_score", "dist_nearest_road_m"), accessibility_composite, True),
    Derived("nse_high_ratio", ("nse_ab_pct",), lambda: F.col("nse_ab_pct"), True),
    Derived("recycling_deficit", ("dist_nearest_recycling_m",), recycling_deficit, True),
    Derived("coverage_gap_index", ("recycling_deficit",), lambda: F.col("recycling_deficit").cast("double"), False),
    Derived("poi_parks_500m", ("has_park_300m",), lambda: F.col("has_park_300m").cast("double"), False),
)


def with_derived(df: DataFrame, refresh: bool) -> DataFrame:
    """Add every derived feature whose inputs exist and that is absent.

    ``refresh`` also replaces the stored values of the refreshed ones (F2);
    without it nothing is overwritten (F1).
    """
    for d in DERIVED:
        there = set(df.columns)
        if there.issuperset(d.inputs) and (d.output not in there or (refresh and d.refreshed)):
            df = df.withColumn(d.output, d.value())
    return df

