"""Datasets, labels, preparation and evaluation operators on hand-sized frames."""

import pytest
from pyspark.sql import functions as F

from sitewise.operators import datasets as ds
from sitewise.operators import evaluate as ev
from sitewise.operators import prep


def test_quantile_label_rate_and_range(spark):
    df = spark.createDataFrame([(i, i / 100.0) for i in range(100)], "k long, s double")
    lab, cut = ds.quantile_label(df, "s", 0.35)
    assert cut == pytest.approx(0.6435)  # linear interpolation at p = 0.65
    assert lab.where("is_optimal = 1").count() == 35
    with pytest.raises(ValueError):
        ds.quantile_label(df, "s", 0.9)


def test_real_candidates_ids_and_audit(spark):
    rows = [(k, 1 if k % 3 == 0 else 0, -12.1, -77.0, None, None) for k in range(1, 13)]
    b = spark.createDataFrame(rows, "zone_key long, is_optimal int, latitude double, longitude double, "
                                    "centroid_lat double, centroid_lon double")
    out = ds.real_candidates(b).orderBy("candidate_id").collect()
    assert [r.candidate_id for r in out] == [f"ECO-REAL-V03-{i:04d}" for i in range(1, 13)]
    pos = [r for r in out if r.is_optimal_legacy == 1]
    assert [r.candidate_id for r in pos] == [f"ECO-REAL-V03-{i:04d}" for i in range(1, len(pos) + 1)]
    assert {r.is_suitable for r in out} == {""} and {r.label_status for r in out} == {"desconocido"}
    assert {r.geometry_quality for r in out} == {"centroid_legacy_available"}
    assert all(r.centroid_lat == -12.1 for r in out)


def test_zero_padding_grows(spark):  # trap 11
    df = spark.createDataFrame([(12345,)], "n long")
    assert df.select(F.format_string(ds.REAL_ID_FORMAT, "n").alias("x")).first().x == "ECO-REAL-V03-12345"


def test_sample_exact_is_repeatable(spark):
    df = spark.createDataFrame([(i,) for i in range(200)], "k long")
    a = [r.k for r in ds.sample_exact(df, 40, "k").collect()]
    b = [r.k for r in ds.sample_exact(df.repartition(7), 40, "k").collect()]
    assert len(a) == 40 and sorted(a) == sorted(b)


def test_stratified_folds_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(103)], "k long, y int")
    f = prep.stratified_folds(df, "y", "k", 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in f if r.y == y]
        assert max(counts) - min(counts) <= 1


def test_rows_of_the_null_group_get_a_fold(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 7, i % 2) for i in range(70)], "k long, g long, y int")
    got = prep.with_cv_folds(df, "g", "y", "k").collect()
    assert sorted(r.k for r in got) == list(range(70)) and {r.fold for r in got} == set(range(5))
    assert len({r.fold for r in got if r.g is None}) == 1


def test_imputation_fitted_on_train_only(spark):
    df = spark.createDataFrame([(1, 1.0, "train"), (2, 3.0, "train"), (3, None, "test"), (4, 100.0, "test")],
                               "k long, v double, split string")
    med = prep.fit_medians(df.where("split = 'train'"), ["v"])
    assert med == {"v": 2.0}
    got = {r.k: r.v for r in prep.apply_fill(df, med).collect()}
    assert got[3] == 2.0 and got[4] == 100.0
    with pytest.raises(ValueError):  # trap 26
        prep.fit_medians(df.where("k = 3"), ["v"])
    m = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (1.0,), (3.0,)], "v double")
    assert prep.fit_mode(m, "v") == 1.0  # tie → smallest


def test_ordinal_unseen_is_minus_one(spark):  # trap 8
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "cat string")
    codes = prep.fit_ordinal(train, "cat")
    df = spark.createDataFrame([("a",), ("c",), ("zz",), (None,)], "cat string")
    got = {r.cat: r.code for r in prep.apply_ordinal(df, "cat", codes, "code").collect()}
    assert got == {"a": 0, "c": 2, "zz": -1, None: -1}


def test_test_groups_are_last_sorted(spark):  # trap 9
    df = spark.createDataFrame([(g,) for g in (5, 1, 9, 3, 9)], "g int")
    assert sorted(r.g for r in prep.test_groups(df, "g", 2).collect()) == [5, 9]
    two = spark.createDataFrame([(1,), (2,)], "g int")
    assert [r.g for r in prep.test_groups(two, "g", 2).collect()] == [2]  # n-1 = 1 group


def test_class_report_averages(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.2, 0), (0.1, 1), (0.7, 1)], "prob double, label int")
    rep = {r.label: r for r in ev.class_report(df, 0.5).collect()}
    assert rep["macro avg"].f1 == pytest.approx((rep["0"].f1 + rep["1"].f1) / 2)
    assert rep["accuracy"].support == 5
    w = (rep["0"].f1 * rep["0"].support + rep["1"].f1 * rep["1"].support) / 5
    assert rep["weighted avg"].f1 == pytest.approx(w)


def test_tier_and_gate(spark):
    r = spark.range(1).select(ev.auc_tier(F.lit(0.81)).alias("a"), ev.auc_tier(F.lit(0.55)).alias("b"),
                              ev.acceptance_gate(F.lit(0.7), F.lit(0.75), F.lit(0.8)).alias("g")).first()
    assert (r.a, r.b, r.g) == ("good", "near_random", True)
