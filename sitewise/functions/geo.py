"""Geometry as column expressions: flat distance, grid, UTM projection.

# fixed values: the flat distance approximation (degrees to km):
# 111 km per degree of latitude, 88 km per degree of longitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEG_LAT = 111.0
KM_PER_DEG_LON = 88.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flat_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """sqrt((Δlat·111)² + (Δlon·88)²) in km (products, not pow, for bit parity)."""
    dy = (_c(lat1) - _c(lat2)) * F.lit(KM_PER_DEG_LAT)
    dx = (_c(lon1) - _c(lon2)) * F.lit(KM_PER_DEG_LON)
    return F.sqrt(dy * dy + dx * dx)


def bucket(coord: Column | str, km_per_deg: float, size_km: float) -> Column:
    """Grid bucket index of a coordinate for cells of ``size_km``."""
    return F.floor(_c(coord) * F.lit(km_per_deg) / F.lit(size_km)).cast("long")


# ---- UTM (F12): transverse Mercator series, WGS84 ------------------------
# fixed values: WGS84 ellipsoid and UTM scale / offsets
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0


def utm_zone_central_meridian(zone: int) -> float:
    return -183.0 + 6.0 * zone


def to_utm(lat: Column | str, lon: Column | str, zone: int = 18, south: bool = True) -> tuple[Column, Column]:
    """Project degrees to UTM metres (EPSG:327xx) with the Krüger series.

    Pure column arithmetic (no UDF); accurate to well under a millimetre
    within the zone.
    """
    a, f = WGS84_A, WGS84_F
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    ]
    e = math.sqrt(f * (2 - f))
    lam0 = math.radians(utm_zone_central_meridian(zone))
    phi = F.radians(_c(lat))
    lam = F.radians(_c(lon)) - F.lit(lam0)
    sphi = F.sin(phi)
    t = F.sinh(F.atanh(sphi) - F.lit(e) * F.atanh(F.lit(e) * sphi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east = eta
    north = xi
    for j, al in enumerate(alpha, start=1):
        east = east + F.lit(al) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        north = north + F.lit(al) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    x = F.lit(UTM_FALSE_EASTING) + F.lit(UTM_K0 * big_a) * east
    y = F.lit(UTM_K0 * big_a) * north + F.lit(UTM_FALSE_NORTHING_SOUTH if south else 0.0)
    return x, y


def from_utm(x: Column | str, y: Column | str, zone: int = 18, south: bool = True) -> tuple[Column, Column]:
    """Inverse of :func:`to_utm` (Krüger series), returns (lat, lon) degrees."""
    a, f = WGS84_A, WGS84_F
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
        n**2 / 48 + n**3 / 15,
        17 * n**3 / 480,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3,
        7 * n**2 / 3 - 8 * n**3 / 5,
        56 * n**3 / 15,
    ]
    lam0 = math.radians(utm_zone_central_meridian(zone))
    xi = (_c(y) - F.lit(UTM_FALSE_NORTHING_SOUTH if south else 0.0)) / F.lit(UTM_K0 * big_a)
    eta = (_c(x) - F.lit(UTM_FALSE_EASTING)) / F.lit(UTM_K0 * big_a)
    xi_p, eta_p = xi, eta
    for j, b in enumerate(beta, start=1):
        xi_p = xi_p - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        eta_p = eta_p - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    phi = chi
    for j, d in enumerate(delta, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    lam = F.lit(lam0) + F.atan2(F.sinh(eta_p), F.cos(xi_p))
    return F.degrees(phi), F.degrees(lam)


def to_utm_sql(lat: str, lon: str, zone: int = 18, south: bool = True) -> tuple[str, str]:
    """SQL text of :func:`to_utm` (same constants and operation order)."""
    a, f = WGS84_A, WGS84_F
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = math.sqrt(f * (2 - f))
    lam0 = math.radians(utm_zone_central_meridian(zone))
    lit = lambda v: f"CAST({v!r} AS DOUBLE)"
    phi = f"radians({lat})"
    lam = f"(radians({lon}) - {lit(lam0)})"
    t = f"sinh(atanh(sin({phi})) - {lit(e)} * atanh({lit(e)} * sin({phi})))"
    xi = f"atan2({t}, cos({lam}))"
    eta = f"atanh(sin({lam}) / sqrt({lit(1.0)} + {t} * {t}))"
    east, north = eta, xi
    for j, al in enumerate(alpha, start=1):
        k = lit(2.0 * j)
        east = f"({east} + {lit(al)} * cos({k} * {xi}) * sinh({k} * {eta}))"
        north = f"({north} + {lit(al)} * sin({k} * {xi}) * cosh({k} * {eta}))"
    x = f"({lit(UTM_FALSE_EASTING)} + {lit(UTM_K0 * big_a)} * {east})"
    y = f"({lit(UTM_K0 * big_a)} * {north} + {lit(UTM_FALSE_NORTHING_SOUTH if south else 0.0)})"
    return x, y
