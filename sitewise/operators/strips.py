"""Radius sums (J5, J9, A23) for many zones: locations sorted along strips, whole chords from running sums.

Zones are grouped by square tiles of the radius's side; the locations of the 3 x 3 tiles around
go with them.  A task cuts a tile into strips and sorts the locations of each along it, so
what a strip has inside a zone's circle is one stretch: the difference of two running sums.  Only
locations at the ends of a stretch, which the strip's width leaves open, are compared one
by one.  So a zone's work grows with the square root of the density of locations, by
NumPy over all zones of a task, and nothing but the zones and 9 copies of each
location is shuffled.

A tile of many zones is split over groups.  What is surely inside or outside is judged with a
margin, as in :mod:`pyramid`; the result is that of comparing every location.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG_LAT, KM_PER_DEG_LON

ZONES = 20_000        # of a group on average
LOCATIONS = 500_000   # that the 3 x 3 tiles around a zone may hold here
PAIRS = 1 << 20       # stretches, or locations compared, at a time
MOST_STRIPS = 32      # of a tile
PLACES = 1 << 26      # along a strip of one tile
MARGIN = 1e-9
WHOLE = ("bigint", "int", "smallint", "tinyint")


class Stretches:
    """The locations of some tiles, sorted by tile, strip and place along it, with running sums of their values."""

    def __init__(self, tile: np.ndarray, x: np.ndarray, y: np.ndarray, lat: np.ndarray, lon: np.ndarray, values: np.ndarray, strips: int, width: float):
        """x, y: from the corner of the tile's 3 x 3 block, in tiles; width: of a tile in km."""
        self.strips, self.width = strips, width
        strip = np.clip(np.floor(x * strips).astype(np.int64), 0, 3 * strips - 1)
        key = self._key(tile, strip, np.floor(y * PLACES).astype(np.int64))
        order = np.argsort(key)
        self.key, self.lat, self.lon, self.values = key[order], lat[order], lon[order], values[:, order]
        self.sums = np.concatenate([np.zeros((len(values), 1), np.int64), self.values.cumsum(axis=1)], axis=1)

    def _key(self, tile: np.ndarray, strip: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (tile * 3 * self.strips + strip) << 28 | np.clip(place, 0, 3 * PLACES)

    def within(self, tile: np.ndarray, x: np.ndarray, y: np.ndarray, lat: np.ndarray, lon: np.ndarray, r_km: float, inclusive: bool) -> np.ndarray:
        """(values, zones): the sums within the radius of each zone."""
        reach = int(np.ceil(r_km / self.width * self.strips)) + 1
        out = np.zeros((len(self.values), len(x)), np.int64)
        step = max(1, PAIRS // (2 * reach + 1))
        for a in range(0, len(x), step):
            b = min(len(x), a + step)
            self._add(out[:, a:b], reach, *(v[a:b] for v in (tile, x, y, lat, lon)), r_km, inclusive)
        return out

    def _add(self, out: np.ndarray, reach: int, tile: np.ndarray, x: np.ndarray, y: np.ndarray, lat: np.ndarray, lon: np.ndarray, r_km: float, inclusive: bool) -> None:
        r, slack = r_km / self.width, MARGIN + 1e-14 * (np.abs(lat * KM_PER_DEG_LAT).max() + np.abs(lon * KM_PER_DEG_LON).max()) / self.width
        strip = np.floor(x * self.strips).astype(np.int64)[:, None] + np.arange(-reach, reach + 1)
        low, high = strip / self.strips - x[:, None], (strip + 1) / self.strips - x[:, None]
        near, far = np.maximum(np.maximum(low, -high) - slack, 0), np.maximum(np.abs(low), np.abs(high)) + slack
        there = (near <= r + slack) & (strip >= 0) & (strip < 3 * self.strips)
        outer = np.sqrt(np.maximum((r + slack) ** 2 - near**2, 0)) + slack
        inner = np.sqrt(np.maximum((r - slack) ** 2 - far**2, 0)) - slack
        zone, at = np.nonzero(there)
        strip, outer, inner, y = strip[zone, at], outer[zone, at], inner[zone, at], y[zone]
        inner = np.where(far[zone, at] < r - slack, inner, 0)
        own = tile[zone]

        def found(place: np.ndarray) -> np.ndarray:
            return np.searchsorted(self.key, self._key(own, strip, place.astype(np.int64)))

        first, end = found(np.floor((y - outer) * PLACES) - 1), found(np.floor((y + outer) * PLACES) + 2)
        start, stop = found(np.floor((y - inner) * PLACES) + 2), found(np.floor((y + inner) * PLACES) - 1)
        none = (inner <= 0) | (start >= stop)
        start, stop = np.where(none, end, start), np.where(none, end, stop)
        heads = np.flatnonzero(np.diff(zone, prepend=-1))
        if not len(heads):
            return
        sums = self.sums[:, stop] - self.sums[:, start]
        out[:, zone[heads]] += np.add.reduceat(sums, heads, axis=1)
        zones, ends = np.concatenate([zone, zone]), np.concatenate([start - first, end - stop])
        begin = np.concatenate([first, stop])
        some = np.flatnonzero(ends > 0)
        zones, ends, begin = zones[some], ends[some], begin[some]
        order = np.argsort(zones, kind="stable")
        zones, ends, begin = zones[order], ends[order], begin[order]
        total = np.cumsum(ends)
        a = 0
        while a < len(ends):  # at least one stretch at a time
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
            self._compare(out, zones[a:b], begin[a:b], ends[a:b], lat, lon, r_km, inclusive)
            a = b

    def _compare(self, out: np.ndarray, zones: np.ndarray, begin: np.ndarray, n: np.ndarray, lat: np.ndarray, lon: np.ndarray, r_km: float, inclusive: bool) -> None:
        before = np.cumsum(n) - n
        at = np.repeat(begin - before, n) + np.arange(int(n.sum()))
        zone = np.repeat(zones, n)
        # the operations of flat_km, in its order
        dy, dx = (lat[zone] - self.lat[at]) * KM_PER_DEG_LAT, (lon[zone] - self.lon[at]) * KM_PER_DEG_LON
        d = np.sqrt(dy * dy + dx * dx)
        inside = np.flatnonzero(d <= r_km if inclusive else d < r_km)
        zone, at = zone[inside], at[inside]
        if len(zone):
            heads = np.flatnonzero(np.diff(zone, prepend=-1))
            out[:, zone[heads]] += np.add.reduceat(self.values[:, at], heads, axis=1)


def _tiles(x: np.ndarray, y: np.ndarray, other_x: np.ndarray, other_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tiles of two lists."""
    _, i = np.unique(np.concatenate([x, other_x]), return_inverse=True)
    _, j = np.unique(np.concatenate([y, other_y]), return_inverse=True)
    _, tile = np.unique(i.astype(np.int64) * (int(j.max()) + 1) + j, return_inverse=True)
    return tile[: len(x)], tile[len(x) :]


def _summed(r_km: float, side: float, measures: list[str], inclusive: bool):  # noqa: ANN202
    def run(zones: pa.Table, locs: pa.Table) -> pa.Table:
        z = {c: zones.column(c).to_numpy() for c in ("tx", "ty", "zlat", "zlon")}
        p = {c: locs.column(c).to_numpy() for c in ("tx", "ty", "plat", "plon", *measures)}
        out = np.zeros((len(measures), zones.num_rows), np.int64)
        if zones.num_rows and locs.num_rows:
            tile, ptile = _tiles(z["tx"], z["ty"], p["tx"], p["ty"])
            place = lambda v, k, c: v * k / side - c + 1
            density = np.bincount(ptile)[ptile].mean() / 9 * np.pi  # locations of a circle
            strips = int(np.clip(np.sqrt(density) / 5, 2, MOST_STRIPS))
            values = np.array([p[m] for m in measures], np.int64)
            held = Stretches(ptile, place(p["plat"], KM_PER_DEG_LAT, p["tx"]), place(p["plon"], KM_PER_DEG_LON, p["ty"]), p["plat"], p["plon"], values, strips, side)
            x, y = place(z["zlat"], KM_PER_DEG_LAT, z["tx"]), place(z["zlon"], KM_PER_DEG_LON, z["ty"])
            order = np.lexsort((y, np.floor(x * strips), tile))  # neighbours look at the same locations
            out[:, order] = held.within(tile[order], x[order], y[order], z["zlat"][order], z["zlon"][order], r_km, inclusive)
        return pa.table({"zlat": z["zlat"], "zlon": z["zlon"], **{f"_{m}": out[k] for k, m in enumerate(measures)}})

    return run


def copies(locs: DataFrame, side: float, measures: list[str]) -> DataFrame:
    """The locations, once for each tile of the 3 x 3 around theirs."""
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    at = locs.withColumns({"cx": F.floor(F.col("plat") * KM_PER_DEG_LAT / F.lit(side)).cast("long"), "cy": F.floor(F.col("plon") * KM_PER_DEG_LON / F.lit(side)).cast("long")})
    at = at.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    return at.select("plat", "plon", *[F.coalesce(F.col(m).cast("long"), F.lit(0)).alias(m) for m in measures], (F.col("cx") + F.col("dx")).alias("tx"), (F.col("cy") + F.col("dy")).alias("ty"))


def width(r_km: float) -> float:
    """Of a tile: a hair more than the radius, so that rounding moves no location two tiles away."""
    return r_km * (1 + 1e-9)


def suit(n_places: int, locs: DataFrame, r_km: float, measures: list[str]) -> bool:
    """Whether there are zones enough to copy the locations for them, values are whole numbers, and every tile's locations fit a task."""
    types = dict(locs.dtypes)
    if not n_places or r_km <= 0 or any(types[m] not in WHOLE for m in measures) or n_places < locs.count():
        return False
    tiles = copies(locs, width(r_km), []).groupBy("tx", "ty").count()
    return tiles.where(F.col("count") > LOCATIONS).isEmpty()


def radius_sums(places: DataFrame, n_places: int, locs: DataFrame, r_km: float, measures: list[str], inclusive: bool = False) -> DataFrame:
    """(zlat, zlon, _measure, ...) of each of the distinct places, 0 where there is no location.

    places: (zlat, zlon), a written table; locs: one row a location with ``plat``, ``plon`` and whole measures.
    """
    side = width(r_km)
    tiled = places.select("zlat", "zlon", F.floor(F.col("zlat") * KM_PER_DEG_LAT / F.lit(side)).cast("long").alias("tx"),
                          F.floor(F.col("zlon") * KM_PER_DEG_LON / F.lit(side)).cast("long").alias("ty"))
    tiles = tiled.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / F.lit(ZONES)).cast("int").alias("salts"))
    group = F.pmod(F.xxhash64("tx", "ty", "salt"), F.lit(-(-n_places // ZONES))).alias("g")
    left = tiled.join(tiles, ["tx", "ty"]).withColumn("salt", F.pmod(F.xxhash64("zlat", "zlon"), F.col("salts")).cast("int"))
    right = copies(locs, side, measures).join(tiles, ["tx", "ty"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    left, right = left.select(group, "tx", "ty", "zlat", "zlon"), right.select(group, "tx", "ty", "plat", "plon", *measures)
    schema = "zlat double, zlon double, " + ", ".join(f"`_{m}` long" for m in measures)
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_summed(r_km, side, measures, inclusive), schema)
