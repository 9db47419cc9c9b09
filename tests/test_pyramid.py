"""Radius sums over the pyramid against brute force; pairs under a hundredfold density."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.operators import pyramid, scoring, spatial


def places(n, seed, spread=0.02):
    rng = np.random.default_rng(seed)
    return np.round(-12.1 + rng.random(n) * spread, 6), np.round(-77.0 + rng.random(n) * spread, 6)


def frames(spark, zones, points):
    z = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(*zones, strict=True))], "zone int, lat double, lon double")
    p = spark.createDataFrame([(i, float(a), float(b), ["x", "y"][i % 2]) for i, (a, b) in enumerate(zip(*points, strict=True))], "point_id int, lat double, lon double, kind string")
    return z, p


def distances(zones, points):
    dy, dx = (zones[0][:, None] - points[0]) * 111.0, (zones[1][:, None] - points[1]) * 88.0
    return np.sqrt(dy * dy + dx * dx)


@pytest.fixture(scope="module")
def crowd(spark):
    # a third of the points within some metres, some of them at one place, and zones among them
    zones, (lat, lon) = places(120, 1), places(3000, 2)
    lat[:1000], lon[:1000] = np.round(-12.09 + np.random.default_rng(3).random(1000) * 1e-4, 6), -76.99
    lat[:50] = -12.09
    zones[0][:10], zones[1][:10] = -12.09, -76.99
    return zones, (lat, lon), *frames(spark, zones, (lat, lon))


@pytest.mark.parametrize("inclusive", [False, True])
def test_counts_equal_brute_force(crowd, inclusive):
    zones, points, z, p = crowd
    d = distances(zones, points)
    for r in (0.5, float(np.sort(d[20])[700])):  # the second radius is the distance of a point
        want = (d <= r if inclusive else d < r).sum(axis=1)
        assert pyramid.crowded(spatial.point_locations(p), r / 2)
        got = {x.zone: x.n for x in spatial.count_within(z, p, r, out="n", inclusive=inclusive).collect()}
        assert [got[i] for i in range(len(want))] == want.tolist()


def test_counts_by_kind_and_features(crowd):
    zones, points, z, p = crowd
    d = distances(zones, points)
    kind = np.arange(3000) % 2
    got = {x.zone: (x.poi_x_500m, x.poi_y_500m) for x in spatial.count_by_kind(z, p, 0.5, ["x", "y"]).collect()}
    assert all(got[i] == (int((d[i] < 0.5)[kind == 0].sum()), int((d[i] < 0.5)[kind == 1].sum())) for i in range(120))
    rows = {x.zone: x for x in scoring.zone_features(z, p).collect()}
    assert len(rows) == 120
    for i in range(120):
        assert rows[i].recycling_density_1km == (d[i] < 0.5).sum() and rows[i].dist_nearest_recycling_m == pytest.approx(d[i].min() * 1000, abs=1e-9)


def test_odd_zones(spark, crowd):
    _, _, _, p = crowd
    z = spark.createDataFrame([(1, -12.09, -76.99, 5), (1, -12.09, -76.99, 5), (2, None, 3.0, 5), (3, 50.0, 50.0, 5)], "zone int, lat double, lon double, n int").drop("n")
    got = sorted((r.zone, r.n) for r in spatial.count_within(z, p, 0.5, out="n").collect())
    assert len(got) == 4 and got[0] == got[1] and got[0][1] >= 1000 and got[2:] == [(2, 0), (3, 0)]


def test_nearest_equals_brute_force(spark, crowd):
    zones, points, z, p = crowd
    far = spark.createDataFrame([(900, -11.0, -75.0), (901, None, 0.0)], "zone int, lat double, lon double")
    assert pyramid.crowded(spatial.point_locations(p), 0.05)
    got = {r.zone: r for r in spatial.nearest(z.unionByName(far), p, r0_km=0.05).collect()}
    assert len(got) == 122 and got[901].nearest_km is None
    lat, lon = np.append(zones[0], -11.0), np.append(zones[1], -75.0)
    d = distances((lat, lon), points)
    for i in range(121):
        r = got[i if i < 120 else 900]
        assert r.nearest_km == d[i].min() and r.nearest_point_id == np.flatnonzero(d[i] == d[i].min()).min()


def test_self_nearest_among_crowds_and_loners(spark):
    lat, lon = places(400, 9, 0.0005)
    lat, lon = np.append(lat, [-12.5, -12.5, -12.9, lat[0]]), np.append(lon, [-77.5, -77.5, -77.9, lon[0]])
    _, p = frames(spark, places(1, 1), (lat, lon))
    got = {r.point_id: r.nearest_km for r in spatial.nearest(p, p, id_col=None, self_exclude=True, r0_km=0.05).collect()}
    d = distances((lat, lon), (lat, lon))
    np.fill_diagonal(d, np.inf)
    assert [got[i] for i in range(404)] == d.min(axis=1).tolist()


def met(monkeypatch, z, p, r):
    """Rows that the zones meet: cells, and locations before their distance decides."""
    seen = []

    def kept(df, name):
        out = df.cache()
        if name == "pyramid-met":
            seen.append(out.count() + sum(x["locations"] for x in out.where(~F.col("inside") & (F.col("locations") <= pyramid.FULL)).select("locations").collect()))
        return out

    monkeypatch.setattr(pyramid, "written", kept)
    spatial.count_within(z, p, r, out="n").count()
    return sum(seen)


def test_pairs_grow_far_less_than_density(spark, monkeypatch):
    zones = places(60, 5)
    work = []
    for n in (2_000, 200_000):
        z, p = frames(spark, zones, places(n, 6))
        work.append(met(monkeypatch, z, p, 0.5) / 60)
    within = (distances(zones, places(200_000, 6)) < 0.5).sum() / 60
    assert work[1] < 12 * work[0] and work[1] < within / 5
