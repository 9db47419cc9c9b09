"""The semantics traps of SURVEY §2.13, one test each."""

import pytest
from pyspark.sql import functions as F

from sitewise.functions import features as fx
from sitewise.operators import evaluate as ev
from sitewise.operators import profile, ranking


def test_clip_keeps_null(spark):  # trap 1
    df = spark.createDataFrame([(None,), (450.0,), (-5.0,)], "d double")
    got = [r.c for r in df.select(fx.clip("d", 0.0, 1.0).alias("c")).collect()]
    assert got == [None, 1.0, 0.0]


def test_deficit_missing_is_zero(spark):  # trap 2
    df = spark.createDataFrame([(None,), (500.0,), (499.9,)], "dist_nearest_recycling_m double")
    assert [r.x for r in df.select(fx.recycling_deficit().alias("x")).collect()] == [0, 1, 0]


def test_rounding_modes(spark):  # trap 3
    r = spark.range(1).select(fx.round_half_up(F.lit(0.12345), 4).alias("a"),
                              fx.round_half_even(F.lit(0.12345), 4).alias("b")).first()
    assert (r.a, r.b) == (0.1235, 0.1234)


def test_median_is_interpolated(spark):  # trap 4
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert ranking.quantile_value(df, "v", 0.5) == 2.5


def test_range_positions_equal_window_positions(spark):
    df = spark.createDataFrame([(float(i % 37), i % 3) for i in range(500)], "v double, g int")
    vc = ranking.value_counts(df, ["g"], "v")
    a = {(r.g, r.v): (r.before, r.n) for r in ranking.positions(vc, ["g"], "v").collect()}
    b = {(r.g, r.v): (r.before, r.n) for r in ranking.positions(vc, ["g"], "v", max_window=0).collect()}
    assert a == b


def test_row_numbers_consecutive(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 2) for i in range(101)], "k long, g int")
    got = sorted(r.seq for r in ranking.row_numbers(df, ["k"]).collect())
    assert got == list(range(1, 102))
    per = ranking.row_numbers(df, ["k"], groups=["g"]).collect()
    for g in (0, 1):
        s = sorted((r.k, r.seq) for r in per if r.g == g)
        assert [x[1] for x in s] == list(range(1, len(s) + 1))


def test_correlation_of_constant_is_null(spark):  # trap 5
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0), (2.0, None)], "c double, t int")
    r = profile.target_correlations(df, ["c"], "t").first()
    assert r.pearson_vs_target is None and r.spearman_vs_target is None and r.n_valid == 3


def test_auc_one_class_is_null_and_ties_averaged(spark):  # trap 6
    one = spark.createDataFrame([(0.3, 1), (0.4, 1)], "prob double, label int")
    assert ev.auc(one).first().auc_roc is None
    tie = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "prob double, label int")
    assert ev.auc(tie).first().auc_roc == pytest.approx(0.875)


def test_auc_complement(spark):
    rows = [(i / 50.0, (i * 7) % 3 == 0) for i in range(50)]
    df = spark.createDataFrame(rows, "prob double, label boolean").withColumn("label", F.col("label").cast("int"))
    a = ev.auc(df).first().auc_roc
    b = ev.auc(df.withColumn("prob", 1 - F.col("prob"))).first().auc_roc
    assert a + b == pytest.approx(1.0)


def test_sweep_rejects_unknown_metric(spark):  # trap 20
    df = spark.createDataFrame([(0.3, 1)], "prob double, label int")
    with pytest.raises(ValueError):
        ev.threshold_sweep(df, "accuracy")


def test_sweep_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    p = rng.random(300)
    y = (rng.random(300) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "prob double, label int")
    got = {r.i: (r.tp, r.fp, r.is_best) for r in ev.threshold_sweep(df).collect()}
    thr = np.linspace(0.25, 0.75, 51)
    f1s = []
    for i, t in enumerate(thr):
        pred = p >= t
        tp, fp = int(((pred) & (y == 1)).sum()), int(((pred) & (y == 0)).sum())
        assert got[i][:2] == (tp, fp)
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / y.sum()
        f1s.append(2 * prec * rec / (prec + rec) if prec + rec else 0.0)
    assert got[int(np.argmax(f1s))][2]


def test_histogram_last_bin_closed(spark):  # trap 13
    df = spark.createDataFrame([(float(i), 1) for i in range(31)], "x double, t int")
    h = profile.class_histogram(df, ["x"], "t").collect()
    assert max(r.bin for r in h) == 29 and sum(r["count"] for r in h) == 31


def test_confusion_cells_sum_to_n(spark):
    df = spark.createDataFrame([(i / 10.0, i % 2) for i in range(10)], "prob double, label int")
    c = ev.confusion(df, 0.5).first()
    assert c.tn + c.fp + c.fn + c.tp == c.n_test == 10


def test_range_positions_without_groups(spark):
    df = spark.createDataFrame([(float(i % 53),) for i in range(400)], "v double")
    vc = ranking.value_counts(df, [], "v")
    a = {r.v: (r.before, r.n) for r in ranking.positions(vc, [], "v").collect()}
    b = {r.v: (r.before, r.n) for r in ranking.positions(vc, [], "v", max_window=0).collect()}
    assert a == b and all(n == 400 for _, n in a.values())


def test_quantiles_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    vals = np.round(rng.normal(size=257), 2)  # ties on purpose
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(vals)], "v double, g int")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.g: r for r in ranking.quantiles(df, ["g"], "v", qs, [f"q{i}" for i in range(len(qs))]).collect()}
    for g in range(3):
        sub = vals[np.arange(len(vals)) % 3 == g]
        for i, q in enumerate(qs):
            assert got[g][f"q{i}"] == pytest.approx(float(np.quantile(sub, q)), abs=1e-12)
    ranks = {r.v: r.avg_rank for r in ranking.average_ranks(df.where("g = 0"), [], "v").collect()}
    sub = np.sort(vals[np.arange(len(vals)) % 3 == 0])
    for v, rk in list(ranks.items())[:20]:
        pos = np.nonzero(sub == v)[0]
        assert rk == pytest.approx(pos.mean() + 1)


def test_utm_round_trip(spark):
    from sitewise.functions.geo import from_utm, to_utm

    df = spark.createDataFrame([(-12.12, -77.03), (-12.0, -75.0), (-5.5, -73.2)], "lat double, lon double")
    x, y = to_utm("lat", "lon")
    u = df.select("lat", "lon", x.alias("x"), y.alias("y"))
    la, lo = from_utm("x", "y")
    for r in u.select("lat", "lon", "x", "y", la.alias("la"), lo.alias("lo")).collect():
        assert r.la == pytest.approx(r.lat, abs=1e-9) and r.lo == pytest.approx(r.lon, abs=1e-9)
        if r.lon == -75.0:  # central meridian of zone 18
            assert r.x == pytest.approx(500000.0, abs=1e-6)
        assert 1_000_000 < r.y < 10_000_000  # southern hemisphere false northing


def test_quantiles_equal_to_sql(spark):
    import random

    import duckdb

    random.seed(5)
    for _ in range(6):
        n = random.randint(2, 60)
        vals = [round(random.uniform(-100, 100), random.randint(0, 6)) for _ in range(n)]
        p = random.choice([0.1, 0.25, 0.33, 0.5, 0.65, 0.75, 0.9])
        want = duckdb.sql(f"select quantile_cont(v, {p}) from (select unnest({vals}::DOUBLE[]) v)").fetchall()[0][0]
        df = spark.createDataFrame([(v,) for v in vals], "v double")
        assert ranking.quantile_value(df, "v", p) == pytest.approx(want, abs=1e-9)
    huge = spark.createDataFrame([(1e305,), (1.1e305,)], "v double")
    assert ranking.quantile_value(huge, "v", 0.5) == pytest.approx(1.05e305)


def test_approx_quantiles_close(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "v double")
    r = ranking.quantiles(df, [], "v", [0.25, 0.5], ["a", "b"], accuracy=10000).first()
    assert abs(r.a - 250.0) <= 1.0 and abs(r.b - 500.0) <= 1.0
