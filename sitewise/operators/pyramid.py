"""Radius sums (J5, J9, A23) and nearest locations (J3, J4) over a pyramid of pre-summed cells.

Locations are counted in square cells of half the radius; a cell of more than ``FULL``
locations is divided into four, and so on.  A zone meets the occupied cells around it.  Cells
wholly inside its circle give their sums at once, cells wholly outside give nothing, and
only cells on the rim go on: to their four quarters, or, once they hold few locations,
to the locations, whose distance decides.  So a zone's work follows the rim of its
circle: it grows with the square root of the density of locations, where a join within
the radius grows with the density itself.

Whether a cell is inside or outside is judged with a margin that is large against the
rounding of coordinates and small against the radius; what falls into the margin counts as
rim.  Hence the result is that of comparing every location.

Cells and locations are shuffled by cell, zones by the cells they ask for, and a cell with
many asking zones is split by Spark's handling of skewed joins, since each side's rows
are independent of one another.

Where zones are at least as many as locations, and a tile's locations fit a task, the sums
come from :mod:`strips` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG_LAT, KM_PER_DEG_LON, flat_km
from ..session import spread, written
from . import strips

#: locations a cell may hold before it is divided
FULL = 32
#: cells on a side of the circle's box at the top are at most 2 * REACH + 1
REACH = 2
MARGIN = 1e-9
#: below this many divisions cells are some millimetres wide for a radius of 1 km
DEEPEST = 18


def _cell(coordinate: Column, side: float) -> Column:
    return F.floor(coordinate / F.lit(side)).cast("long")


def _axis(z: Column, i: Column, side: float) -> tuple[Column, Column]:
    """The least and the largest distance on one axis between z and the stretch [i, i + 1) sides."""
    low, high = z - i * F.lit(side), (i + 1) * F.lit(side) - z
    return F.greatest(-low, -high, F.lit(0.0)), F.greatest(low, high)


def crowded(locs: DataFrame, side: float) -> bool:
    """Whether some cell holds more locations than a zone should meet one by one."""
    cells = locs.groupBy(_cell(F.col("plat") * KM_PER_DEG_LAT, side).alias("ix"), _cell(F.col("plon") * KM_PER_DEG_LON, side).alias("iy")).count()
    return not cells.where(F.col("count") > FULL).isEmpty()


def radius_sums(zones: DataFrame, locs: DataFrame, r_km: float, measures: list[str], zlat: str = "lat", zlon: str = "lon", inclusive: bool = False) -> DataFrame:
    """The zones with the sums of ``measures`` over all locations within ``r_km`` (0 where there are none).

    locs: one row a location with ``plat``, ``plon`` and the measures.
    """
    # equal zone rows and zones at one place ask once
    places = zones.where(F.col(zlat).isNotNull() & F.col(zlon).isNotNull()).select(F.col(zlat).alias("zlat"), F.col(zlon).alias("zlon")).distinct()
    places = written(places, "pyramid-places")
    n_places = places.count()
    if strips.suit(n_places, locs, r_km, measures):
        return _with_sums(zones, strips.radius_sums(places, n_places, locs, r_km, measures, inclusive), measures, zlat, zlon)
    places = spread(places, n_places).withColumns({"zx": F.col("zlat") * KM_PER_DEG_LAT, "zy": F.col("zlon") * KM_PER_DEG_LON})
    left = locs.select("plat", "plon", (F.col("plat") * KM_PER_DEG_LAT).alias("px"), (F.col("plon") * KM_PER_DEG_LON).alias("py"), *measures)

    side = r_km / REACH
    around = F.sequence(F.lit(-REACH - 1), F.lit(REACH + 1))
    asking = places.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    asking = asking.select("zlat", "zlon", "zx", "zy", (_cell(F.col("zx"), side) + F.col("dx")).alias("ix"), (_cell(F.col("zy"), side) + F.col("dy")).alias("iy"))
    distance = flat_km("zlat", "zlon", "plat", "plon")
    within = distance <= F.lit(r_km) if inclusive else distance < F.lit(r_km)
    found: list[DataFrame] = []
    for depth in range(DEEPEST + 1):
        left = left.withColumns({"ix": _cell(F.col("px"), side), "iy": _cell(F.col("py"), side)})
        cells = written(left.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("locations"), *[F.sum(m).alias(m) for m in measures]), "pyramid-cells")
        (near_x, far_x), (near_y, far_y) = _axis(F.col("zx"), F.col("ix"), side), _axis(F.col("zy"), F.col("iy"), side)
        asking = asking.where(near_x * near_x + near_y * near_y <= F.lit((r_km * (1 + MARGIN)) ** 2))
        inside = far_x * far_x + far_y * far_y < F.lit((r_km * (1 - MARGIN)) ** 2)
        met = written(asking.join(cells, ["ix", "iy"]).withColumn("inside", inside), "pyramid-met")
        found.append(met.where("inside").select("zlat", "zlon", *measures))
        rim = met.where("not inside").drop(*measures)
        last = depth == DEEPEST
        few = F.lit(True) if last else F.col("locations") <= FULL
        pairs = rim.where(few).join(left, ["ix", "iy"]).where(within)
        found.append(pairs.select("zlat", "zlon", *measures))
        full = cells.where(F.col("locations") > FULL).select("ix", "iy")
        if last or full.isEmpty():
            break
        side /= 2
        left = written(left.join(full, ["ix", "iy"], "left_semi").select("plat", "plon", "px", "py", *measures), "pyramid-locations")
        quarters = F.array(F.lit(0), F.lit(1))
        asking = rim.where(~few).withColumn("dx", F.explode(quarters)).withColumn("dy", F.explode(quarters))
        asking = asking.select("zlat", "zlon", "zx", "zy", (F.col("ix") * 2 + F.col("dx")).alias("ix"), (F.col("iy") * 2 + F.col("dy")).alias("iy"))
    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    return _with_sums(zones, parts.groupBy("zlat", "zlon").agg(*[F.sum(m).alias(f"_{m}") for m in measures]), measures, zlat, zlon)


def _with_sums(zones: DataFrame, sums: DataFrame, measures: list[str], zlat: str, zlon: str) -> DataFrame:
    out = zones.alias("z").join(sums.alias("s"), (F.col(f"z.`{zlat}`") == F.col("s.zlat")) & (F.col(f"z.`{zlon}`") == F.col("s.zlon")), "left")
    return out.select(*[F.col(f"z.`{c}`") for c in zones.columns], *[F.coalesce(F.col(f"s._{m}"), F.lit(0)).alias(m) for m in measures])


def _occupied(locs: DataFrame, side: float) -> DataFrame:
    """(ix, iy, locations, points): the cells of a side that hold locations."""
    at = locs.select(_cell(F.col("px"), side).alias("ix"), _cell(F.col("py"), side).alias("iy"), "weight")
    return at.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("locations"), F.sum("weight").alias("points"))


def _bounded(asking: DataFrame, cells: DataFrame, side: float, self_exclude: bool) -> DataFrame:
    """Asking zones with the occupied cells they meet: ``near``, and ``bound``, the distance within which a location must lie.

    Among the zones' own points a cell that holds a zone's point alone bounds nothing.
    """
    (near_x, far_x), (near_y, far_y) = _axis(F.col("zx"), F.col("ix"), side), _axis(F.col("zy"), F.col("iy"), side)
    met = asking.join(cells, ["ix", "iy"]).withColumns({"near": F.sqrt(near_x * near_x + near_y * near_y), "far": F.sqrt(far_x * far_x + far_y * far_y)})
    other = (F.col("near") > 0) | (F.col("points") > 1) if self_exclude else F.lit(True)
    own = Window.partitionBy("zlat", "zlon")  # the cells of one zone
    return met.withColumn("bound", F.least("bound", F.min(F.when(other, F.col("far"))).over(own))).drop("far", "points")


def nearest_location(zones: DataFrame, locs: DataFrame, start_km: float, diameter_km: float, zlat: str = "lat", zlon: str = "lon", self_exclude: bool = False) -> DataFrame:
    """(zlat, zlon, best struct(d, p)): the nearest location of each distinct place of a zone, the smallest id on ties.

    First zones meet occupied cells, of a side that doubles until the 3 x 3 cells around a
    zone must hold its nearest location.  Then cells are divided, level by level: a zone
    keeps the quarters that may hold a location as near as the least distance within which
    some quarter must hold one, and meets the locations of a cell once it holds few.  So a
    crowded cell costs a zone a few cells a level, not its locations.

    locs: one row a location with ``plat``, ``plon``, ``pid`` and ``weight``.
    """
    here = locs.select("plat", "plon", "pid", "weight", (F.col("plat") * KM_PER_DEG_LAT).alias("px"), (F.col("plon") * KM_PER_DEG_LON).alias("py"))
    pending = zones.where(F.col(zlat).isNotNull() & F.col(zlon).isNotNull()).select(F.col(zlat).alias("zlat"), F.col(zlon).alias("zlon")).distinct()
    pending = pending.withColumns({"zx": F.col("zlat") * KM_PER_DEG_LAT, "zy": F.col("zlon") * KM_PER_DEG_LON, "bound": F.lit(float("inf"))})
    place = ["zlat", "zlon", "zx", "zy"]
    reach, around = {}, F.array(*[F.lit(d) for d in (-1, 0, 1)])
    level = 0
    while True:
        side = start_km * 2.0**level
        asking = pending.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        asking = asking.select(*place, "bound", (_cell(F.col("zx"), side) + F.col("dx")).alias("ix"), (_cell(F.col("zy"), side) + F.col("dy")).alias("iy"))
        last = side >= diameter_km
        met = written(_bounded(asking, _occupied(here, side), side, self_exclude), "nearest-met")
        settled = met if last else met.where(F.col("bound") <= side * (1 - MARGIN))
        reach[level] = settled.where(F.col("near") <= F.col("bound") * (1 + MARGIN))
        if last:
            break
        pending = written(pending.join(settled.select("zlat", "zlon").distinct(), ["zlat", "zlon"], "left_anti"), "nearest-pending")
        if pending.isEmpty():
            break
        level += 1
    found, active = [], None
    distance = flat_km("zlat", "zlon", "plat", "plon")
    while True:
        side = start_km * 2.0**level
        active = reach[level] if active is None else active.unionByName(reach[level]) if level in reach else active
        few = F.lit(True) if level <= -DEEPEST else F.col("locations") <= FULL
        meeting = active.where(few).join(here.withColumns({"ix": _cell(F.col("px"), side), "iy": _cell(F.col("py"), side)}), ["ix", "iy"])
        if self_exclude:
            meeting = meeting.where((F.col("plat") != F.col("zlat")) | (F.col("plon") != F.col("zlon")) | (F.col("weight") >= 2))
        found.append(meeting.select("zlat", "zlon", F.struct(distance.alias("d"), F.col("pid").alias("p")).alias("at")))
        crowds = active.where(~few)
        if level <= min(reach) and (level <= -DEEPEST or crowds.isEmpty()):
            break
        level -= 1
        side /= 2
        halves = F.array(F.lit(0), F.lit(1))
        asking = crowds.withColumn("dx", F.explode(halves)).withColumn("dy", F.explode(halves))
        asking = asking.select(*place, "bound", (F.col("ix") * 2 + F.col("dx")).alias("ix"), (F.col("iy") * 2 + F.col("dy")).alias("iy"))
        active = _bounded(asking, _occupied(here, side), side, self_exclude)
        active = written(active.where(F.col("near") <= F.col("bound") * (1 + MARGIN)), "nearest-met")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("zlat", "zlon").agg(F.min("at").alias("best"))
