"""Radius sums over strips against brute force; what many zones leave behind on the way."""

import numpy as np
import pytest
from test_pyramid import distances, frames, places

from sitewise.operators import pyramid, spatial, strips


@pytest.fixture(scope="module")
def many():
    # more zones than points; a third of the points within some metres, repeated places, zones on points
    zones, (lat, lon) = places(4000, 11), places(1500, 12)
    lat[:500], lon[:500] = np.round(-12.09 + np.random.default_rng(13).random(500) * 1e-4, 6), -76.99
    lat[:50] = -12.09
    zones[0][:30], zones[1][:30] = -12.09, -76.99
    zones[0][30:400], zones[1][30:400] = lat[500:870], lon[500:870]
    zones[0][400:420] += 0.5
    return zones, (lat, lon)


@pytest.mark.parametrize("inclusive", [False, True])
def test_counts_equal_brute_force(spark, many, monkeypatch, inclusive):
    zones, points = many
    z, p = frames(spark, zones, points)
    d, written = distances(zones, points), pyramid.written
    for r in (0.3, float(np.sort(d[2000])[200])):  # the second radius is the distance of a point
        rows = []

        def counted(df, name, rows=rows):
            out = written(df, name)
            rows.append(out.count())
            return out

        monkeypatch.setattr(pyramid, "written", counted)
        want = (d <= r if inclusive else d < r).sum(axis=1)
        got = {x.zone: x.n for x in spatial.count_within(z, p, r, out="n", inclusive=inclusive).collect()}
        assert [got[i] for i in range(len(want))] == want.tolist()
        assert sum(rows) <= len(want)  # a row a zone and cell around it before


def test_crowded_tiles_and_odd_zones(spark, many, monkeypatch):
    zones, points = many
    z, p = frames(spark, zones, points)
    z = z.unionByName(spark.createDataFrame([(4000, None, 3.0), (4001, 50.0, 50.0), (4001, 50.0, 50.0)], "zone int, lat double, lon double"))
    kind = np.arange(1500) % 2
    d = distances(zones, points) < 0.5
    monkeypatch.setattr(strips, "ZONES", 300)  # a tile's zones are split
    for most in (strips.LOCATIONS, 100):       # and tiles of too many locations go by the pyramid
        monkeypatch.setattr(strips, "LOCATIONS", most)
        rows = spatial.count_by_kind(z, p, 0.5, ["x", "y"]).collect()
        got = {x.zone: (x.poi_x_500m, x.poi_y_500m) for x in rows}
        assert len(rows) == 4003 and got[4000] == got[4001] == (0, 0)
        assert all(got[i] == (d[i][kind == 0].sum(), d[i][kind == 1].sum()) for i in range(4000))


@pytest.mark.parametrize("n_strips", [2, 7, 32])
def test_any_number_of_strips(monkeypatch, n_strips):
    rng = np.random.default_rng(n_strips)
    monkeypatch.setattr(strips, "MOST_STRIPS", n_strips)
    monkeypatch.setattr(strips, "PAIRS", 500)
    lat, lon = np.round(rng.random(3000) * 0.03, 4), np.round(rng.random(3000) * 0.03, 4)  # a grid: many distances are equal
    zlat, zlon = np.append(lat[:300], rng.random(300) * 0.03), np.append(lon[:300], rng.random(300) * 0.03)
    value = rng.integers(-5, 1 << 40, (2, 3000))
    one = lambda v: np.ones(len(v), np.int64)
    x, y = lambda v: (v + 0.03) * 111 / 4, lambda v: (v + 0.03) * 88 / 4
    held = strips.Stretches(one(lat), x(lat), y(lon), lat, lon, value, n_strips, 4.0)
    d = distances((zlat, zlon), (lat, lon))
    for r, inclusive in ((1.11, False), (1.11, True), (3.9, False), (float(d[400, 7]), True), (float(d[400, 7]), False)):
        want = value @ (d <= r if inclusive else d < r).T.astype(np.int64)
        assert (held.within(one(zlat), x(zlat), y(zlon), zlat, zlon, r, inclusive) == want).all()
