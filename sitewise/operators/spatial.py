"""Spatial joins (J-series) as bucketed equi-joins.

A plain ``dist < r`` join condition plans as a nested-loop join.  Instead both
sides get a grid bucket of size ``r`` (in km), the point side is copied to its
3×3 neighbour buckets, and the sides meet in an equi-join on the bucket; the
exact distance is then a residual condition.  A point within ``r`` of a zone
is always in one of the 9 buckets around it, so the result is exact.

Scale measures:
* points are pre-aggregated per exact location (weight = number of points)
  before they are copied and shuffled, so duplicates never multiply the join;
* hot buckets (one bucket may hold a third of all zones) are split by a salt
  on the zone side and the matching point buckets are replicated per salt;
  the hot-bucket table is joined as a frame;
* aggregation after the join groups by the join keys plus the zone columns,
  so it reuses the join's hash partitioning instead of shuffling again;
* nearest neighbour doubles the radius for the zones still unresolved
  (exact: a distance below ``r`` cannot be beaten outside the 3×3 block).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG_LAT, KM_PER_DEG_LON, bucket, flat_km
from ..session import cached, spread
from . import pyramid

# grid cells are a hair larger than the radius so that a point at exactly
# distance r cannot fall two buckets away through floating-point rounding
_PAD = 1.0 + 1e-9
DEFAULT_SKEW_ROWS = 2_000_000


def point_locations(points: DataFrame, pid: str = "point_id", lat: str = "lat", lon: str = "lon",
                    extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Pre-aggregate points per exact location: ``(plat, plon, pid_min, weight)``."""
    return (
        points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .groupBy(F.col(lat).alias("plat"), F.col(lon).alias("plon"), *[F.col(k) for k in extra_keys])
        .agg(F.min(pid).alias("pid"), F.count(F.lit(1)).alias("weight"))
    )


def _hot_buckets(zb: DataFrame, skew_rows: int) -> DataFrame:
    """Buckets holding more than ``skew_rows`` zones, with their salt count."""
    return (
        zb.groupBy("bx", "by").count().where(F.col("count") > F.lit(skew_rows))
        .select("bx", "by", F.ceil(F.col("count") / F.lit(skew_rows)).cast("int").alias("nsalt"))
    )


def _bucketed(zones: DataFrame, locs: DataFrame, size_km: float, zlat: str, zlon: str,
              skew_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Bucket zones; copy locations to neighbour buckets; add skew salts."""
    size = size_km * _PAD
    zb = zones.withColumns({"bx": bucket(zlat, KM_PER_DEG_LAT, size), "by": bucket(zlon, KM_PER_DEG_LON, size)})
    offsets = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    pb = (
        locs.withColumns({"cx": bucket("plat", KM_PER_DEG_LAT, size), "cy": bucket("plon", KM_PER_DEG_LON, size)})
        .withColumn("dx", F.explode(offsets))
        .withColumn("dy", F.explode(offsets))
        .withColumns({"bx": F.col("cx") + F.col("dx"), "by": F.col("cy") + F.col("dy")})
        .drop("cx", "cy", "dx", "dy")
    )
    if not skew_rows:
        return zb.withColumn("salt", F.lit(0)), pb.withColumn("salt", F.lit(0))
    hb = _hot_buckets(zb, skew_rows)  # few rows: the planner broadcasts them once it knows their size
    zb = zb.join(hb, ["bx", "by"], "left").withColumn(
        "salt", F.pmod(F.xxhash64(*[F.col(c) for c in zones.columns]), F.coalesce("nsalt", F.lit(1))).cast("int")
    ).drop("nsalt")
    pb = pb.join(hb, ["bx", "by"], "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("nsalt", F.lit(1)) - 1))
    ).drop("nsalt")
    return zb, pb


def radius_aggregate(zones: DataFrame, locs: DataFrame, r_km: float, aggs: list[Column],
                     zlat: str = "lat", zlon: str = "lon", inclusive: bool = False,
                     skew_rows: int | None = DEFAULT_SKEW_ROWS, prune_points: bool = False) -> DataFrame:
    """Left join zones to pre-aggregated locations within ``r_km``; aggregate per zone.

    Zones without any location in range keep their row (aggregates see nulls).
    ``aggs`` may use ``weight``, ``pid``, ``dist_km`` and any location column.
    ``prune_points``: first keep only point copies whose bucket holds a zone
    (a semi-join on the zones' distinct buckets, broadcast by the planner
    when that set is small) — for few zones against many points.
    """
    zcols = zones.columns
    zb, pb = _bucketed(zones, locs, r_km, zlat, zlon, skew_rows)
    zb = zb.withColumn("_row", F.monotonically_increasing_id())  # equal zone rows stay apart in the grouping
    if prune_points:
        pb = pb.join(zb.select("bx", "by").distinct(), ["bx", "by"], "left_semi")
    zb, pb = zb.alias("z"), pb.alias("p")
    z, p = (lambda c: F.col(f"z.`{c}`")), (lambda c: F.col(f"p.`{c}`"))
    dist = flat_km(z(zlat), z(zlon), p("plat"), p("plon"))
    within = dist <= F.lit(r_km) if inclusive else dist < F.lit(r_km)
    cond = (z("bx") == p("bx")) & (z("by") == p("by")) & (z("salt") == p("salt")) & within
    pcols = [c for c in pb.columns if c not in ("bx", "by", "salt") and c not in zcols]
    joined = zb.join(pb, cond, "left").select(
        z("bx").alias("bx"), z("by").alias("by"), z("salt").alias("salt"), z("_row").alias("_row"), *[z(c).alias(c) for c in zcols],
        *[p(c).alias(c) for c in pcols],
        F.when(p("plat").isNotNull(), dist).alias("dist_km"),
    )
    return joined.groupBy("bx", "by", "salt", "_row", *zcols).agg(*aggs).drop("bx", "by", "salt", "_row")


def count_within(zones: DataFrame, points: DataFrame, r_km: float, out: str = "n_within",
                 zlat: str = "lat", zlon: str = "lon", inclusive: bool = False,
                 self_id: str | None = None, skew_rows: int | None = DEFAULT_SKEW_ROWS) -> DataFrame:
    """Number of points within ``r_km`` (strict by default); zero kept.

    With ``self_id`` the zones are the points themselves and each row's own
    point (always at distance 0) is not counted.  Where locations crowd, zones meet
    sums of cells instead (:mod:`pyramid`); the rows are the same.
    """
    locs = cached(point_locations(points))
    if pyramid.crowded(locs, r_km / pyramid.REACH):
        res = pyramid.radius_sums(zones, locs.withColumnRenamed("weight", out), r_km, [out], zlat, zlon, inclusive)
    else:
        res = radius_aggregate(spread(zones, zones.count()), locs, r_km, [F.coalesce(F.sum("weight"), F.lit(0)).alias(out)],
                               zlat, zlon, inclusive, skew_rows)
    if self_id:
        res = res.withColumn(out, F.col(out) - 1)
    return res


def exists_within(zones: DataFrame, points: DataFrame, r_km: float, out: str = "has_point",
                  zlat: str = "lat", zlon: str = "lon", inclusive: bool = True,
                  skew_rows: int | None = DEFAULT_SKEW_ROWS) -> DataFrame:
    """1 if any point is within ``r_km`` (inclusive by default), else 0.

    Zones that share a cell of 0.7 radii with a point are settled by the list of
    occupied cells (its diagonal is under the radius); only the others meet
    points.  So the pairs don't grow with the number of points near a zone.
    """
    locs = point_locations(points)
    side = r_km * 0.7
    cells = {"_cx": bucket(zlat, KM_PER_DEG_LAT, side), "_cy": bucket(zlon, KM_PER_DEG_LON, side)}
    occupied = locs.select(bucket("plat", KM_PER_DEG_LAT, side).alias("_cx"), bucket("plon", KM_PER_DEG_LON, side).alias("_cy")).distinct()
    marked = zones.withColumns(cells).join(occupied.withColumn("_near", F.lit(1)), ["_cx", "_cy"], "left")
    settled = marked.where(F.col("_near").isNotNull()).select(*zones.columns, F.lit(1).alias(out))
    undecided = marked.where(F.col("_near").isNull()).select(*zones.columns)
    rest = radius_aggregate(undecided, locs, r_km, [F.max(F.col("pid").isNotNull()).cast("int").alias(out)],
                            zlat, zlon, inclusive, skew_rows, prune_points=True)
    return settled.unionByName(rest)


def _extent(zones: DataFrame, locs: DataFrame, zlat: str, zlon: str) -> tuple[float, int, float, int]:
    """Diameter (km) of the box around zones and points, location count,
    point-box area (km²) and zone count, from one small job (two one-row
    aggregates)."""
    def box(df: DataFrame, la: str, lo: str, side: int) -> DataFrame:
        return df.agg(F.lit(side).alias("side"), F.min(la).alias("a"), F.max(la).alias("b"),
                      F.min(lo).alias("c"), F.max(lo).alias("d"), F.count(F.lit(1)).alias("n"))
    rows = {r["side"]: r for r in box(zones, zlat, zlon, 0).unionByName(box(locs, "plat", "plon", 1)).collect()}
    zr, pr = rows[0], rows[1]
    n = int(pr["n"])
    if n == 0 or zr["a"] is None:
        return 0.0, n, 0.0, int(zr["n"])
    lat_lo, lat_hi = min(zr["a"], pr["a"]), max(zr["b"], pr["b"])
    lon_lo, lon_hi = min(zr["c"], pr["c"]), max(zr["d"], pr["d"])
    diam = math.hypot((lat_hi - lat_lo) * KM_PER_DEG_LAT, (lon_hi - lon_lo) * KM_PER_DEG_LON)
    area = (pr["b"] - pr["a"]) * KM_PER_DEG_LAT * (pr["d"] - pr["c"]) * KM_PER_DEG_LON
    return diam, n, area, int(zr["n"])


def _nearest_in_block(zones: DataFrame, locs: DataFrame, r_km: float, with_id: bool, zlat: str, zlon: str, self_exclude: bool,
                      skew_rows: int | None, prune_points: bool) -> DataFrame:
    """The zones with ``best``, the least (distance, id), or distance, of the locations in the 3×3 cells around each.

    A cell's block of locations is one row with an array, so the join gives a row a
    zone and nothing is sorted or aggregated after it.  Only for cells that aren't crowded.
    """
    zb, pb = _bucketed(zones, locs.where("pid is not null"), r_km, zlat, zlon, skew_rows)
    if prune_points:
        pb = pb.join(zb.select("bx", "by").distinct(), ["bx", "by"], "left_semi")
    blocks = pb.groupBy("bx", "by", "salt").agg(F.collect_list(F.struct("plat", "plon", "pid", "weight")).alias("_block"))
    found = F.col("_block")
    if self_exclude:
        found = F.filter(found, lambda p: (p["plat"] != F.col(zlat)) | (p["plon"] != F.col(zlon)) | (p["weight"] >= 2))

    def at(p: Column) -> Column:
        d = flat_km(zlat, zlon, p["plat"], p["plon"])
        return F.struct(d.alias("d"), p["pid"].alias("p")) if with_id else d

    met = zb.join(blocks, ["bx", "by", "salt"], "left")
    return met.select(*[F.col(f"`{c}`") for c in zones.columns], F.array_min(F.transform(found, at)).alias("best"))


def _nearest_by_pyramid(zones: DataFrame, locs: DataFrame, r_km: float, diam: float, with_id: bool, zlat: str, zlon: str, self_exclude: bool) -> DataFrame:
    """The same rows where cells are crowded."""
    best = pyramid.nearest_location(zones, locs, r_km, diam, zlat, zlon, self_exclude).alias("b")
    out = zones.alias("z").join(best, (F.col(f"z.`{zlat}`") == F.col("b.zlat")) & (F.col(f"z.`{zlon}`") == F.col("b.zlon")), "left")
    return out.select(*[F.col(f"z.`{c}`") for c in zones.columns], F.col("b.best" if with_id else "b.best.d").alias("best"))


def nearest(zones: DataFrame, points: DataFrame, zlat: str = "lat", zlon: str = "lon",
            dist_col: str = "nearest_km", id_col: str | None = "nearest_point_id",
            self_exclude: bool = False, r0_km: float | None = None,
            skew_rows: int | None = DEFAULT_SKEW_ROWS,
            extra_aggs: list[Column] | None = None, min_r0_km: float = 0.0) -> DataFrame:
    """Exact nearest point per zone by radius doubling.

    Round k joins the still-unresolved zones to points within the 3×3 block
    of cells of size r_k and accepts a zone when its best distance is < r_k.
    The start radius follows the point density (about four locations per
    cell); rounds stop when every zone is resolved, at the latest once a
    cell spans the whole extent, so the answer equals the brute-force
    minimum.  Ties on distance go to the smallest point id.

    ``extra_aggs`` are radius aggregates (over ``dist_km``, ``weight``, …)
    computed in the first round for every zone, which is exact for radii up
    to ``min_r0_km`` (the first round's radius is at least that); this fuses
    e.g. the 500 m count into the same join.

    Where locations crowd in a cell of a round, its zones are led down a
    pyramid of cells instead (:mod:`pyramid`); the rows are the same.

    ``self_exclude``: the zones are the points themselves; a
    row's own location is skipped unless another point shares it (then the
    distance is 0).  Zones get NULL when there are no points at all.
    """
    extra_aggs = extra_aggs or []
    locs = cached(point_locations(points))
    diam, n_locs, area, n_zones = _extent(zones, locs, zlat, zlon)
    if skew_rows and n_zones <= skew_rows:
        skew_rows = None  # no bucket can hold more zones than there are: skip the hot-bucket scans
    # no points (diam 0): the single final round leaves every zone NULL
    r = max(r0_km or 2.0 * math.sqrt(max(area, 1e-6) / max(n_locs, 1)), min_r0_km, 1e-3)
    best_d = F.col("best.d") if id_col else F.col("best")
    pending, done = spread(zones, n_zones), []
    while True:
        last = r * 2.0 >= diam * _PAD or diam == 0.0
        # in the last round a cell as large as the whole extent sees every point
        size = max(r, diam) * 2.0 + 1e-6 if last else r
        if not done and extra_aggs:
            candidate = F.col("pid").isNotNull()
            if self_exclude:
                candidate = candidate & ((F.col("plat") != F.col(zlat)) | (F.col("plon") != F.col(zlon)) | (F.col("weight") >= 2))
            if id_col:
                # (distance, id) as one struct: smallest id on equal distances.  Struct
                # buffers are sort-aggregated; only callers that want the id pay it.
                best = F.min(F.when(candidate, F.struct(F.col("dist_km").alias("d"), F.col("pid").alias("p")))).alias("best")
            else:
                best = F.min(F.when(candidate, F.col("dist_km"))).alias("best")  # hash-aggregated double
            res = radius_aggregate(pending, locs, size, [best, *extra_aggs], zlat, zlon, inclusive=True, skew_rows=skew_rows)
        elif n_locs and pyramid.crowded(locs, size):
            done.append(_nearest_by_pyramid(pending, locs, r, diam, bool(id_col), zlat, zlon, self_exclude))
            break
        else:
            res = _nearest_in_block(pending, locs, size, bool(id_col), zlat, zlon, self_exclude, skew_rows, prune_points=bool(done))
        if last:
            done.append(res)
            break
        res = cached(res)
        done.append(res.where(best_d < F.lit(r)))
        pending = res.where(F.col("best").isNull() | (best_d >= F.lit(r))).drop("best")
        if pending.isEmpty():
            break
        r *= 2.0
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    cols = {dist_col: best_d}
    if id_col:
        cols[id_col] = F.col("best.p")
    return out.withColumns(cols).drop("best")


def count_by_kind(zones: DataFrame, points: DataFrame, r_km: float, kinds: list[str],
                  kind_col: str = "kind", prefix: str = "poi_", suffix: str = "_500m",
                  skew_rows: int | None = DEFAULT_SKEW_ROWS) -> DataFrame:
    """Per-zone counts of points by kind within ``r_km``; zeros kept.

    Locations are pre-aggregated per (location, kind); the pivot is a set of
    conditional sums over a fixed kind list, so no extra pass discovers kinds.
    """
    locs = cached(point_locations(points, extra_keys=(kind_col,)))
    if pyramid.crowded(locs, r_km / pyramid.REACH):
        names = [f"{prefix}{k}{suffix}" for k in kinds]
        by_kind = locs.groupBy("plat", "plon").agg(*[F.coalesce(F.sum(F.when(F.col(kind_col) == k, F.col("weight"))), F.lit(0)).alias(n) for k, n in zip(kinds, names, strict=True)])
        return pyramid.radius_sums(zones, by_kind, r_km, names)
    aggs = [
        F.coalesce(F.sum(F.when(F.col(kind_col) == F.lit(k), F.col("weight"))), F.lit(0)).alias(f"{prefix}{k}{suffix}")
        for k in kinds
    ]
    return radius_aggregate(spread(zones, zones.count()), locs, r_km, aggs, skew_rows=skew_rows)
