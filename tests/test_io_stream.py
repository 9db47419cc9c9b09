"""Write-once tables, checked broadcasts, and stream scoring equal to batch scoring."""

import math
import os

from pyspark.sql import functions as F

from sitewise.operators import booster as bo
from sitewise.operators import pyramid, spatial
from sitewise.operators.joins import bounded_broadcast
from sitewise.sources import materialize
from sitewise.streaming import point_stream
from sitewise.streaming.score_stream import read_sink, score_stream


def test_materialized_built_once(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    spark.range(10).write.parquet(src)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(src).withColumn("y", F.col("id") * 2)

    a = materialize.materialized(spark, "t_test", [src], build)
    b = materialize.materialized(spark, "t_test", [src], build)
    assert len(calls) == 1 and a.count() == b.count() == 10
    spark.range(20).write.mode("overwrite").parquet(src)  # new source identity → rebuilt
    c = materialize.materialized(spark, "t_test", [src], build)
    assert len(calls) == 2 and c.count() == 20
    d = materialize.materialized(spark, "t_test", [src], build, code=[materialize])  # code in the key
    assert len(calls) == 3 and d.count() == 20


def test_bounded_broadcast_only_when_small(spark):
    small = spark.range(5)
    big = spark.range(50)
    assert "broadcast" in bounded_broadcast(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in bounded_broadcast(big, 10)._jdf.queryExecution().logical().toString().lower()


def test_stream_scoring_equals_batch(spark, tmpdir_path):
    rows = [(i, float(i * 37 % 20000), float(i % 10) / 10, float(i % 300), float(i % 7) / 7, float(i * 13 % 900),
             int(i % 4), float(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "candidate_id long, population_density double, nse_ab_pct double, "
                                     "dist_nearest_road_m double, walkability_score double, "
                                     "dist_nearest_recycling_m double, land_use_encoded int, label double")
    p, spec = bo.prepare(df, ["population_density", "nse_ab_pct", "walkability_score"], ["land_use_encoded"], "candidate_id"), bo.Model(0, {"n_estimators": 3, "num_leaves": 8, "min_child_samples": 5})
    model = bo.trained(p, bo.fit(p, [spec]), spec)
    src = os.path.join(tmpdir_path, "in")
    feats = df.drop("label")
    feats.write.parquet(src)
    score_stream(spark, src, feats.schema, model, 0.5, os.path.join(tmpdir_path, "out"),
                 os.path.join(tmpdir_path, "chk"))
    streamed = {(r.zone_id, r.suitability_score, r.is_recommended)
                for r in read_sink(spark, os.path.join(tmpdir_path, "out")).collect()}
    batch = model.transform(feats).select(
        F.col("candidate_id").cast("string").alias("zone_id"), F.round("prob", 4).alias("s"),
        (F.col("prob") >= 0.5).alias("f")).collect()
    assert streamed == {(r.zone_id, r.s, r.f) for r in batch}


def test_counts_of_arriving_points_in_any_order(spark, tmpdir_path):
    z = spark.createDataFrame([(i, -12.0 - i * 1e-3, -77.0) for i in range(30)] + [(99, 10.0, 10.0), (100, None, 1.0)], "zone int, lat double, lon double")
    spots = [(i, -12.0 - (i * 37 % 40) * 1e-3, -77.0 + (i % 5) * 1e-3) for i in range(200)] + [(500, None, -77.0)]
    p = spark.createDataFrame(spots, "point_id int, lat double, lon double")
    want = {r.zone: r.n for r in spatial.count_within(z, p, 0.5, out="n").collect()}
    for name, order in (("a", F.col("point_id")), ("b", -F.col("point_id"))):
        base = os.path.join(tmpdir_path, name)
        for turn in range(2):
            part = p.where(F.pmod(order, F.lit(4)) < 2) if turn == 0 else p.where(F.pmod(order, F.lit(4)) >= 2)
            part.repartition(3).write.mode("append").parquet(f"{base}/in")
            point_stream.follow(spark, f"{base}/in", p.schema, z, 0.5, "zone", f"{base}/out", f"{base}/chk", files_per_batch=1)
        got = {r.zone: r.n for r in point_stream.counts(spark, f"{base}/out", z, "zone", "n").collect()}
        assert got == want and sum(got.values()) > 500


def test_crowded_batches_go_by_the_pyramid(spark, tmpdir_path, monkeypatch):
    """A crowd of arriving points meets a zone as sums of cells, not one by one; counts and distances are those of all pairs."""
    z = spark.createDataFrame([(1, -12.0, -77.0), (1, -12.0, -77.0), (2, -12.003, -77.0), (3, 10.0, 10.0)], "zone int, lat double, lon double")
    spots = [(i, -12.0 - (i % 40) * 1e-4, -77.0 - (i // 40) * 1e-4) for i in range(1600)]
    p = spark.createDataFrame(spots, "point_id int, lat double, lon double")
    p.coalesce(1).write.parquet(f"{tmpdir_path}/in")
    calls, sums = [], pyramid.radius_sums
    monkeypatch.setattr(pyramid, "radius_sums", lambda *a, **k: calls.append(1) or sums(*a, **k))
    point_stream.follow(spark, f"{tmpdir_path}/in", p.schema, z, 0.3, "zone", f"{tmpdir_path}/out", f"{tmpdir_path}/chk")
    assert calls
    got = {r.zone: (r.n, r.nearest_km) for r in point_stream.counts(spark, f"{tmpdir_path}/out", z, "zone", "n").collect()}
    for zone, lat, twice in ((1, -12.0, 2), (2, -12.003, 1)):
        d = [math.hypot((lat - a) * 111.0, (-77.0 - b) * 88.0) for _, a, b in spots]
        assert got[zone][0] == twice * sum(x < 0.3 for x in d) > 100 and abs(got[zone][1] - min(d)) < 1e-9
    assert got[3] == (0, None)
