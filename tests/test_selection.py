"""Exact quantiles by selection against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.operators import selection

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 5000
    cols = {
        "normal": rng.normal(0, 1, n), "wide": np.exp(rng.normal(0, 40, n)), "ties": rng.integers(0, 4, n).astype(float), "one": np.full(n, 7.0),
        "ends": np.where(rng.random(n) < 0.5, -1.7e308, 1.7e308), "near": 1.0 + rng.integers(0, 3, n) * 2.0**-52, "holes": np.where(rng.random(n) < 0.3, np.nan, rng.normal(5, 2, n)), "none": np.full(n, np.nan)}
    rows = [(i % 3, *[None if np.isnan(x[i]) and i % 2 else float(x[i]) for x in cols.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "kind int, " + ", ".join(f"{c} double" for c in cols)).repartition(4).cache(), {**cols, "kind": np.arange(n) % 3}


def test_quantiles_of_all_rows_and_of_populations(data):
    df, cols = data
    names = [c for c in cols if c != "kind"]
    populations = {"all": None, "not 1": [0, 2], 2: [2], "nobody": [9]}
    masks = {"all": cols["kind"] >= 0, "not 1": cols["kind"] != 1, 2: cols["kind"] == 2, "nobody": cols["kind"] == 9}
    got = selection.quantiles(df, names, PROBS, "kind", populations)
    for p, mask in masks.items():
        for c in names:
            values = np.sort(cols[c][mask & ~np.isnan(cols[c])])
            s = got[p, c]
            assert s["n"] == len(values)
            for q in PROBS:
                if not len(values):
                    assert s.quantile(q) is None
                    continue
                at = q * (len(values) - 1)
                low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
                with np.errstate(over="ignore"):
                    assert s.quantile(q) == (low if low == high and np.floor(at) == np.ceil(at) else low + (high - low) * (at - np.floor(at)))


def test_without_groups_and_rows(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("x"))
    got = selection.quantiles(df, ["x"], [0.5])[None, "x"]
    assert got.quantile(0.5) == np.median(np.arange(20_000) * 7919 % 1_000_003)
    assert selection.quantiles(df.limit(0), ["x"], [0.5])[None, "x"].quantile(0.5) is None
