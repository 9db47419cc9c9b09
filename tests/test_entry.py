"""Driver contract and a few golden checks on the smallest data set."""

import __spark_entry__ as E


def test_contract_keys(spark):
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["candidate_id", "district_id", "suitability_score", "is_recommended",
                          "recycling_density_1km", "dist_nearest_recycling_m"]
    scores = [r.suitability_score for r in rows]
    assert scores == sorted(scores, reverse=True)


def test_group_folds_never_split_groups(spark):
    from sitewise.operators import prep

    df = spark.createDataFrame([(g, i) for g in range(12) for i in range(g + 1)], "g int, i int")
    folds = {r.g: r.fold for r in prep.group_folds(df, "g", 5).collect()}
    assert set(folds) == set(range(12)) and set(folds.values()) == set(range(5))
    sizes = [0] * 5
    for g, f in folds.items():
        sizes[f] += g + 1
    assert max(sizes) - min(sizes) <= 12


def test_spatial_split_needs_two_groups(spark):
    import pytest

    from sitewise.operators import prep

    with pytest.raises(ValueError):
        prep.spatial_split(spark.createDataFrame([(1,)], "g int"), "g")
