"""Bucketed spatial joins equal brute force (SURVEY §5 property (d))."""

import math

import numpy as np
import pytest

from sitewise import session
from sitewise.operators import spatial


def _pts(rng, n, dup=0):
    lat = -12.2 + rng.random(n) * 0.1
    lon = -77.1 + rng.random(n) * 0.1
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    for k in range(dup):  # duplicate coordinates under new ids
        _, a, b = rows[k]
        rows.append((n + k, a, b))
    return rows


def _d(a, b):
    dy, dx = (a[1] - b[1]) * 111.0, (a[2] - b[2]) * 88.0
    return math.sqrt(dy * dy + dx * dx)


@pytest.mark.parametrize("skew_rows", [None, 5])
def test_nearest_and_count_match_brute_force(spark, skew_rows):
    rng = np.random.default_rng(7)
    z = _pts(rng, 120)
    p = _pts(rng, 40, dup=5)
    zdf = spark.createDataFrame(z, "candidate_id long, lat double, lon double")
    pdf = spark.createDataFrame(p, "point_id long, lat double, lon double")
    nn = spatial.nearest(zdf, pdf, skew_rows=skew_rows).collect()
    got = {r.candidate_id: (r.nearest_km, r.nearest_point_id) for r in nn}
    cnt = {r.candidate_id: r.n for r in spatial.count_within(zdf, pdf, 0.5, out="n", skew_rows=skew_rows).collect()}
    for zr in z:
        ds = sorted((_d(zr, pr), pr[0]) for pr in p)
        assert got[zr[0]][0] == pytest.approx(ds[0][0], abs=1e-12)
        assert got[zr[0]][1] == ds[0][1]
        assert cnt[zr[0]] == sum(1 for d, _ in ds if d < 0.5)


def test_self_nearest_counts_duplicates(spark):
    rng = np.random.default_rng(3)
    p = _pts(rng, 30, dup=3)
    pdf = spark.createDataFrame(p, "point_id long, lat double, lon double")
    got = {r.point_id: r.nearest_km for r in spatial.nearest(pdf, pdf, id_col=None, self_exclude=True).collect()}
    for a in p:
        best = min(_d(a, b) for b in p if b[0] != a[0])
        assert got[a[0]] == pytest.approx(best, abs=1e-12)


def test_exists_inclusive_radius(spark):
    z = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0)], "candidate_id long, lat double, lon double")
    # a point exactly 0.3 km north of zone 1 (0.3 / 111 degrees)
    p = spark.createDataFrame([(9, 0.3 / 111.0, 0.0)], "point_id long, lat double, lon double")
    got = {r.candidate_id: r.has_point for r in spatial.exists_within(z, p, 0.3, inclusive=True).collect()}
    assert got == {1: 1, 2: 0}


def test_no_points_gives_null(spark):
    z = spark.createDataFrame([(1, 0.0, 0.0)], "candidate_id long, lat double, lon double")
    p = spark.createDataFrame([], "point_id long, lat double, lon double")
    r = spatial.nearest(z, p).collect()[0]
    assert r.nearest_km is None


def test_radius_counts_property(spark):
    """Random radii, strict and inclusive: bucketed == brute force."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    rng = np.random.default_rng(11)
    z = _pts(rng, 60)
    p = _pts(rng, 30, dup=4)
    zdf = spark.createDataFrame(z, "candidate_id long, lat double, lon double").persist()
    pdf = spark.createDataFrame(p, "point_id long, lat double, lon double").persist()

    @settings(max_examples=6, deadline=None)
    @given(r=st.floats(min_value=0.05, max_value=3.0), inclusive=st.booleans())
    def check(r, inclusive):
        got = {x.candidate_id: x.n for x in
               spatial.count_within(zdf, pdf, r, out="n", inclusive=inclusive).collect()}
        for zr in z:
            ds = [_d(zr, pr) for pr in p]
            want = sum(1 for d in ds if (d <= r if inclusive else d < r))
            assert got[zr[0]] == want

    check()


def test_poi_pivot_by_kind(spark):
    rng = np.random.default_rng(5)
    z = _pts(rng, 40)
    p = [(i, a, b, ["x", "y"][i % 2]) for i, a, b in _pts(rng, 30)]
    zdf = spark.createDataFrame(z, "candidate_id long, lat double, lon double")
    pdf = spark.createDataFrame(p, "point_id long, lat double, lon double, kind string")
    got = {r.candidate_id: (r.poi_x_500m, r.poi_y_500m) for r in spatial.count_by_kind(zdf, pdf, 0.5, ["x", "y"]).collect()}
    for zr in z:
        want = tuple(sum(1 for pr in p if pr[3] == k and _d(zr, pr) < 0.5) for k in ("x", "y"))
        assert got[zr[0]] == want


def test_nearest_id_without_sorting_pairs(spark):
    """Between the join and a zone's row nothing is aggregated or sorted by zone, so a task's memory doesn't follow the pairs."""
    z = spark.range(200).selectExpr("id AS zone", "-12.0 + (id * 37 % 101) * 1e-3 AS lat", "-77.0 + (id * 53 % 97) * 1e-3 AS lon")
    p = spark.range(80).selectExpr("cast(if(id % 10 = 0, null, id) as bigint) AS point_id", "-12.0 + (id * 29 % 71) * 1.5e-3 AS lat", "-77.0 + (id * 31 % 73) * 1.5e-3 AS lon")
    out = spatial.nearest(z, p, r0_km=3.0)  # one round settles all
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" in plan
    points = [r for r in p.collect() if r.point_id is not None]
    for r in out.collect():
        d, i = min((math.hypot((r.lat - q.lat) * 111.0, (r.lon - q.lon) * 88.0), q.point_id) for q in points)
        assert abs(r.nearest_km - d) < 1e-9 and abs(math.hypot((r.lat - points[[q.point_id for q in points].index(r.nearest_point_id)].lat) * 111.0,
                                                               (r.lon - points[[q.point_id for q in points].index(r.nearest_point_id)].lon) * 88.0) - d) < 1e-9


def test_rows_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    assert session.spread(spark.range(0, 1000, 1, 1), 1000).rdd.getNumPartitions() == 10
    assert session.spread(spark.range(0, 50, 1, 1), 50).rdd.getNumPartitions() == 1
