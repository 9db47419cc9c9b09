"""Results that must not depend on caches, input size, nulls or repeated rows."""

import pytest
from pyspark.sql import functions as F

from sitewise.functions.features import with_derived
from sitewise.operators import booster as bo
from sitewise.operators import evaluate, prep, ranking, spatial
from sitewise.session import cached, release_cached


def test_row_numbers_survive_released_caches(spark):
    df = cached(spark.range(200_003).withColumn("k", F.xxhash64("id")))
    numbered = ranking.row_numbers(df, ["k"], "n")
    release_cached()
    got = numbered.agg(F.countDistinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert (got.d, got.a, got.b) == (200_003, 1, 200_003)


def test_positions_paths_agree_with_null_and_reordered_groups(spark):
    rows = [(g, h, float(v % 5)) for g in (None, "a", "b") for h in (1, None) for v in range(9)]
    vc = ranking.value_counts(spark.createDataFrame(rows, "h string, g int, v double"), ["g", "h"], "v")
    one = sorted(map(str, ranking.positions(vc, ["g", "h"], "v").collect()))
    other = sorted(map(str, ranking.positions(vc, ["g", "h"], "v", max_window=1).collect()))
    assert one == other and len(one) == 30


def test_row_numbers_with_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, k int")
    got = {r.k: r.n for r in ranking.row_numbers(df, ["k"], "n", groups=["g"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("sizes", [[7, 5, 5, 3, 3, 3, 2, 1, 1, 1, 1], [40] + [1] * 70, [3, 3, 3], [9, 9, 9, 8, 8, 1, 1, 1, 1, 1, 1], [2] * 23 + [5] * 4])
def test_group_folds_follow_the_greedy_rule(spark, sizes):
    df = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "g int")
    load, want = [0] * 5, {}
    for g, n in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        f = min(range(5), key=lambda i: (load[i], i))
        load[f] += n
        want[g] = f
    assert {r.g: r.fold for r in prep.group_folds(df, "g", 5).collect()} == want


def test_auc_of_very_many_positives(spark):
    scored = spark.createDataFrame([(0.2, 0), (0.9, 1)], "prob double, label int")
    assert evaluate.auc(scored).first()["auc_roc"] == 1.0


def test_equal_zone_rows_survive(spark):
    zones = spark.createDataFrame([(1, -12.0, -77.0), (1, -12.0, -77.0)], "candidate_id int, lat double, lon double")
    points = spark.createDataFrame([(5, -12.0, -77.0)], "point_id int, lat double, lon double")
    assert [r.n_within for r in spatial.count_within(zones, points, 1.0).collect()] == [1, 1]
    assert spatial.exists_within(zones, points, 1.0).count() == 2


def test_medians_interpolate_and_fill(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    fills = prep.fit_medians(df, ["x"])
    assert sorted(r.x for r in prep.apply_fill(df.select(bo.known("x").alias("x")), fills).collect()) == [1.0, 2.0, 2.5, 2.5, 3.0, 10.0]


def test_ordinal_codes_have_no_category_limit(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("x"))
    codes = prep.fit_ordinal(df, "x")
    seen = prep.apply_ordinal(df.unionByName(spark.createDataFrame([(-5.0,), (None,)], "x double")), "x", codes, "y")
    assert seen.where("y = x").count() == 3000 and seen.where("y = -1").count() == 2


def test_derived_features_fill_or_refresh(spark):
    df = spark.createDataFrame([(0.5, 600.0, 9.0)], "nse_ab_pct double, dist_nearest_recycling_m double, nse_high_ratio double")
    filled, refreshed = with_derived(df, refresh=False).first(), with_derived(df, refresh=True).first()
    assert (filled.nse_high_ratio, refreshed.nse_high_ratio) == (9.0, 0.5)
    assert filled.recycling_deficit == 1 and filled.coverage_gap_index == 1.0


def test_utm_control_points_on_the_central_meridian(spark):
    """Northings on the central meridian are meridian arcs, integrated here from the ellipsoid."""
    import math

    from sitewise.functions.geo import to_utm

    a, f = 6378137.0, 1 / 298.257223563  # fixed values: the WGS84 ellipsoid
    e2 = f * (2 - f)

    def arc(lat, n=20_000):
        step = math.radians(lat) / n
        return sum(a * (1 - e2) / (1 - e2 * math.sin((i + 0.5) * step) ** 2) ** 1.5 * step for i in range(n))

    df = spark.createDataFrame([(lat, -75.0) for lat in (0.0, -5.5, -12.0464, -18.35)], "lat double, lon double")
    x, y = to_utm("lat", "lon")
    for r in df.select("lat", x.alias("x"), y.alias("y")).collect():
        assert r.x == pytest.approx(500_000, abs=1e-6)
        assert r.y == pytest.approx(10_000_000 - 0.9996 * arc(-r.lat), abs=1e-3)


def test_cv_folds_fall_back_to_stratified(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(60)], "k long, g long, y long")
    few, enough = prep.with_cv_folds(df, "g", "y", "k"), prep.with_cv_folds(df, "k", "y", "k")
    assert {(r.fold, r.y): r["count"] for r in few.groupBy("fold", "y").count().collect()} == {(f, y): 10 for f in range(3) for y in (0, 1)}
    assert enough.select("fold").distinct().count() == 5 and enough.count() == 60


def test_samples_follow_the_seed(spark):
    from sitewise.operators.datasets import sample_exact

    df = spark.createDataFrame([(f"key{i}",) for i in range(50)], "k string")
    pick = lambda seed: {r.k for r in sample_exact(df, 10, "k", seed).collect()}
    assert pick(1) == pick(1) != pick(2) and len(pick(1)) == 10


@pytest.mark.parametrize("inclusive", [True, False])
def test_exists_within_equals_brute_force_in_dense_places(spark, inclusive):
    import numpy as np

    rng = np.random.default_rng(3)
    zones = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-12.1, -12.0, 120), rng.uniform(-77.1, -77.0, 120)))] + [(900, None, -77.0), (901, -12.05, -77.05)]
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(-12.05, 0.01, 400), rng.normal(-77.05, 0.01, 400)))] + [(990, -12.05, -77.05)]
    z = spark.createDataFrame(zones, "candidate_id int, lat double, lon double")
    got = {r.candidate_id: r.has_point for r in spatial.exists_within(z, spark.createDataFrame(points, "point_id int, lat double, lon double"), 0.3, inclusive=inclusive).collect()}
    near = lambda d: d <= 0.3 if inclusive else d < 0.3
    want = {i: int(a is not None and any(near(((a - p) * 111) ** 2 + ((b - q) * 88) ** 2 and (((a - p) * 111) ** 2 + ((b - q) * 88) ** 2) ** 0.5) for _, p, q in points)) for i, a, b in zones}
    assert got == want and 0 < sum(want.values()) < len(want)
