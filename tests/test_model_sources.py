"""SHAP additivity, persistence, sources/sinks and polygon properties."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.operators import explain as xp
from sitewise.operators import booster as bo
from sitewise.operators import polygon as pg
from sitewise.sources import files


def test_shap_adds_up_to_margin(spark, tmpdir_path):
    rng = np.random.default_rng(0)
    n = 400
    rows = []
    for i in range(n):
        a, b, c = rng.random(3)
        rows.append((i, float(a * 20000), float(b), float(c * 400), float(c), float(b * 900), int(i % 4),
                     int(a + b > 1.0)))
    df = spark.createDataFrame(rows, "candidate_id long, population_density double, nse_ab_pct double, "
                                     "dist_nearest_road_m double, walkability_score double, "
                                     "dist_nearest_recycling_m double, land_use_encoded int, label int").withColumn("label", F.col("label").cast("double"))
    names = ["population_density", "nse_ab_pct", "dist_nearest_road_m", "walkability_score"]
    spec = bo.Model(0, {"n_estimators": 5, "num_leaves": 8, "min_child_samples": 5})
    p = bo.prepare(df, names, ["land_use_encoded"], "candidate_id")
    model = bo.trained(p, bo.fit(p, [spec]), spec)
    path = os.path.join(tmpdir_path, "m")
    bo.save(spark, model, path, {"threshold": 0.4, "serving_threshold": 0.6})
    loaded, meta = bo.load(spark, path)
    assert bo.serving_threshold(meta) == 0.6
    scored = loaded.transform(df)
    out = xp.explain(scored, loaded, ["candidate_id", "prob"]).collect()
    for r in out[:50]:
        logit = math.log(r.prob / (1 - r.prob))
        assert r.base + sum(r.shap) == pytest.approx(logit, abs=1e-9)
        assert len(r.top_features) == 5
        mags = [abs(t.shap_value) for t in r.top_features]
        assert mags == sorted(mags, reverse=True)
    plain = xp.scored_records(scored, loaded, ["candidate_id", "prob"], with_explanation=False)
    assert plain.columns == ["candidate_id", "prob"] and plain.count() == len(out)
    assert xp.scored_records(scored, loaded, ["candidate_id"], with_explanation=True).columns == ["candidate_id", "top_features"]


def _conditional(tree, codes, known, node=0):
    """The tree's value when only some features are known: unknown splits go both ways by cover."""
    f = tree["feature"][node]
    if f < 0:
        return tree["value"][node]
    a, b = tree["left"][node], tree["right"][node]
    if f in known:
        return _conditional(tree, codes, known, a if codes[f] <= tree["bin"][node] else b)
    return sum(_conditional(tree, codes, known, c) * tree["cover"][c] for c in (a, b)) / tree["cover"][node]


def test_shap_values_by_their_definition():
    from itertools import combinations

    from sitewise.operators import trees as T

    rng = np.random.default_rng(8)
    x = rng.integers(0, 20, (400, 5)).astype(np.uint8)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 10) + rng.normal(0, 4, 400) > 14).astype(np.uint8)
    params = {**bo.BASE_PARAMS, "n_estimators": 3, "num_leaves": 12, "min_child_samples": 5, "colsample_bytree": 1.0}
    forest = [t for _, t in T.boosted(x, y, np.zeros(400, bool), np.arange(400), params, None)]
    for rows in (x[:7], x):  # looked up for the patterns that occur, and for all
        got = xp.shap_values(forest, rows, 5)
        for r in range(7):
            for i in range(5):
                others, want = [f for f in range(5) if f != i], 0.0
                for size in range(5):
                    weight = math.factorial(size) * math.factorial(4 - size) / math.factorial(5)
                    for s in combinations(others, size):
                        want += weight * sum(_conditional(t, rows[r], {*s, i}) - _conditional(t, rows[r], set(s)) for t in forest)
                assert got[r, i] == pytest.approx(want, abs=1e-9)


def test_load_missing_model_raises(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        bo.load(spark, os.path.join(tmpdir_path, "absent"))


def test_csv_roundtrip_latin1(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "pts.csv")
    with open(p, "w", encoding="latin-1") as f:
        f.write('N,Distrito,Direccion\n1,"Jesús María","Av. Brasil, 123"\n')
    df = files.read_csv(spark, p, "N long, Distrito string, Direccion string", encoding="ISO-8859-1")
    r = df.first()
    assert (r.N, r.Distrito, r.Direccion) == (1, "Jesús María", "Av. Brasil, 123")
    out = os.path.join(tmpdir_path, "out")
    files.write_csv(df, out)
    assert files.read_csv(spark, out, df.schema).count() == 1
    assert files.resolve_source(spark, os.path.join(tmpdir_path, "nope"), p) == p
    with pytest.raises(FileNotFoundError):
        files.resolve_source(spark, os.path.join(tmpdir_path, "nope"))


def test_run_log_latest(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "runs")
    files.append_run(spark, p, {"auc": 0.8})
    files.append_run(spark, p, {"auc": 0.9})
    assert json.loads(files.latest_run(spark, p).first().record) == {"auc": 0.9}


def test_records_to_zones(spark):
    df = files.records_to_zones(spark, [{"population_density": 1.0, "recycling_deficit": None}, {"area_m2": 3.0}])
    assert df.count() == 2 and len(df.columns) == 20
    assert files.head_records(df, 1, ["area_m2"]).count() == 1


def test_boundary_edges(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "b.json")
    poly = [[[-77.07, -12.09], [-77.05, -12.09], [-77.05, -12.08], [-77.07, -12.09]]]
    with open(p, "w") as f:
        json.dump([{"name": "X", "geojson": {"type": "Polygon", "coordinates": poly}},
                   {"name": "Y", "geojson": {"type": "Point", "coordinates": [-77.0, -12.0]}}], f)
    e = files.boundary_edges(spark, p)
    assert e.count() == 3


def test_clip_areas_sum_to_polygon_area(spark):
    v = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 0.0), (1, 3, 1.5, 1.0), (1, 4, 3.0, 3.0),
                               (1, 5, 0.0, 3.0)], "g int, seq int, x double, y double")
    bb = pg.bbox_of(v, "g")
    cells = pg.grid_cells(bb, "g")
    edges = pg.oriented(pg.edges(v, "g"), "g")
    total = pg.clipped_cells(cells, edges, bb, "g").agg(F.sum("clip_area_km2")).first()[0]
    area = pg.shoelace(v, "g").first().area_km2
    assert total == pytest.approx(area, rel=1e-9)
    inside = pg.inside_polygon(cells, pg.edges(v, "g"), bb, "g").where("inside").count()
    assert abs(inside * 0.25 - area) <= 1.5


def _clip_square(ring, size):
    """Sutherland–Hodgman: the ring clipped to [0, size] squared; its area and centroid."""
    poly = ring
    for axis, bound, above in ((0, 0.0, True), (0, size, False), (1, 0.0, True), (1, size, False)):
        res = []
        for i in range(len(poly)):
            cur, prev = poly[i], poly[i - 1]
            cin, pin = ((p[axis] >= bound) if above else (p[axis] <= bound) for p in (cur, prev))
            if cin != pin:
                t = (bound - prev[axis]) / (cur[axis] - prev[axis])
                res.append((prev[0] + t * (cur[0] - prev[0]), prev[1] + t * (cur[1] - prev[1])))
            if cin:
                res.append(cur)
        poly = res
    a = sx = sy = 0.0
    for i in range(len(poly)):
        (x1, y1), (x2, y2) = poly[i - 1], poly[i]
        cr = x1 * y2 - x2 * y1
        a, sx, sy = a + cr / 2, sx + (x1 + x2) * cr / 6, sy + (y1 + y2) * cr / 6
    return (abs(a), sx / a, sy / a) if a else (0.0, 0.0, 0.0)


@pytest.mark.parametrize("vertices", [9, 400])
def test_clipped_cells_equal_clipping_one_by_one(spark, vertices):
    rng = np.random.default_rng(vertices)
    ang = np.sort(rng.random(vertices) * 2 * np.pi)
    rad = 1.0 + rng.random(vertices) * 3.0
    ring = [(-6700.0 + float(r * np.cos(a)), -1350.0 + float(r * np.sin(a))) for a, r in zip(ang, rad, strict=True)]
    ring += [(-6700.5, ring[0][1]), (-6700.5, ring[0][1] - 0.5)] if vertices == 9 else []  # a flat and an upright edge
    v = spark.createDataFrame([(1, i + 1, x, y) for i, (x, y) in enumerate(ring)], "g int, seq int, x double, y double")
    bb = pg.bbox_of(v, "g")
    for order in (1, -1):
        e = pg.edges(v.withColumn("seq", F.col("seq") * order), "g")
        got = {(r.ix, r.iy): r for r in pg.clipped_cells(pg.grid_cells(bb, "g"), pg.oriented(e, "g"), bb, "g").collect()}
        kept = 0
        for c in pg.grid_cells(bb, "g").collect():
            area, cx, cy = _clip_square([(x - c.x0, y - c.y0) for x, y in ring], 0.5)
            if area < 1e-9:
                assert (c.ix, c.iy) not in got or got[c.ix, c.iy].clip_area_km2 < 2e-9
                continue
            kept += 1
            r = got[c.ix, c.iy]
            assert r.clip_area_km2 == pytest.approx(area, abs=1e-8) and r.whole == (area > 0.25 - 1e-11)
            assert (r.clip_cx - c.x0, r.clip_cy - c.y0) == pytest.approx((cx, cy), abs=1e-5)
        assert kept > 40


def test_boundary_parts_holes_and_directions(spark, tmpdir_path):
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    places = [{"name": "M", "geojson": {"type": "MultiPolygon", "coordinates": [[square(0, 0, 4), square(1, 1, 2)], [square(6, 0, 1)[::-1]]]}},
              {"name": "P", "geojson": {"type": "Polygon", "coordinates": [square(0, 0, 4)[::-1], square(1, 1, 2)[:-1]]}},  # clockwise, its hole not closed
              {"name": "L", "geojson": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}, {"name": "N", "geojson": None}]
    for lines in (False, True):
        path = os.path.join(tmpdir_path, f"b{lines}.json")
        with open(path, "w") as f:
            f.write("\n".join(map(json.dumps, places)) if lines else json.dumps(places))
        e = files.boundary_edges(spark, path, lines)
        turned = pg.oriented(e, "name", "part", "ring")
        assert {r.name: r.area_km2 for r in pg.ring_area(turned, "name").collect()} == {"M": 13.0, "P": 12.0}
        assert {(r["name"], r["count"]) for r in e.groupBy("name").count().collect()} == {("M", 12), ("P", 8)}
        box = e.groupBy("name").agg(F.min("x1").alias("xmin"), F.min("y1").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"))
        cells = pg.grid_cells(box, "name")
        parts = pg.clipped_cells(cells, turned, box, "name")
        assert {r.name: (round(r.a, 9), r.n) for r in parts.groupBy("name").agg(F.sum("clip_area_km2").alias("a"), F.count("*").alias("n")).collect()} == {"M": (13.0, 52), "P": (12.0, 48)}
        inside = pg.inside_polygon(cells, e, box, "name").where("inside").groupBy("name").count()
        assert {(r["name"], r["count"]) for r in inside.collect()} == {("M", 52), ("P", 48)}


def test_cross_validate_paths(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        a, b = rng.random(2)
        rows.append((i, float(a * 20000), float(b), 100.0, float(a), float(b * 900), int(i % 4),
                     float(a + 0.3 * b > 0.7), i % 3))
    df = spark.createDataFrame(rows, "candidate_id long, population_density double, nse_ab_pct double, "
                                     "dist_nearest_road_m double, walkability_score double, "
                                     "dist_nearest_recycling_m double, land_use_encoded int, label double, fold int")
    p = bo.prepare(df, ["population_density", "nse_ab_pct", "walkability_score"], ["land_use_encoded"], "candidate_id", fold="fold")
    small = {"n_estimators": 4, "num_leaves": 8, "min_child_samples": 5}
    res = bo.search(p, [small], patience=None)
    assert len(res) == 1 and 0.5 < res[0]["mean"] <= 1.0 and res[0]["trees"] == [4, 4, 4]
    draws = [{**small, "learning_rate": 0.1}, {**small, "learning_rate": 0.3}]
    res = bo.search(p, draws, patience=2, seconds=600)
    assert len(res) == 2 and [r["params"] for r in res if r["best"]][0] in draws


def test_ordinal_codes_roundtrip(spark, tmpdir_path):
    train = spark.createDataFrame([(i, float(i % 5), c, float(i % 2)) for i, c in enumerate([3.0, 1.0, 10.0, None] * 10)], "candidate_id long, x double, c double, label double")
    p = bo.prepare(train, ["x"], ["c"], "candidate_id")
    spec = bo.Model(0, {"n_estimators": 2, "num_leaves": 3, "min_child_samples": 2})
    path = os.path.join(tmpdir_path, "enc")
    bo.save(spark, bo.trained(p, bo.fit(p, [spec]), spec), path, {})
    back, meta = bo.load(spark, path)
    df = spark.createDataFrame([(1.0,), (3.0,), (10.0,), (2.0,), (None,)], "c double").withColumn("x", F.lit(1.0))
    got = {r.c: r.features[1] for r in back.transform(df).collect()}
    assert meta == {} and got == {1.0: 0.0, 3.0: 1.0, 10.0: 2.0, 2.0: -1.0, None: 0.0}  # null takes the most frequent one, the least on ties


def test_class_weighted_fit(spark):
    rows = [(i, float(i), float(i % 7 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "candidate_id long, population_density double, label double")
    df = df.withColumns({"nse_ab_pct": F.lit(0.5), "dist_nearest_road_m": F.lit(10.0), "walkability_score": F.lit(0.5),
                         "dist_nearest_recycling_m": F.lit(100.0), "land_use_encoded": F.lit(1)})
    n1 = sum(1 for r in rows if r[2] == 1.0)
    no, yes = bo.balanced(df)["class_weight"]
    assert yes == pytest.approx(200 / (2 * n1)) and no == pytest.approx(200 / (2 * (200 - n1)))
    p = bo.prepare(df, ["population_density"], ["land_use_encoded"], "candidate_id")
    spec = bo.Model(0, {"n_estimators": 3, "num_leaves": 4, "min_child_samples": 1, **bo.balanced(df)})
    m = bo.trained(p, bo.fit(p, [spec]), spec)
    # balanced classes start at even odds
    assert m.forest[0]["value"][0] == pytest.approx(0.0, abs=1e-12)


def test_shap_values_find_their_quadrature_points_once(monkeypatch):
    calls, points = [], np.polynomial.legendre.leggauss
    monkeypatch.setattr(np.polynomial.legendre, "leggauss", lambda n: calls.append(n) or points(n))
    tree = {"feature": np.array([0, 1, -1, -1, -1]), "bin": np.array([3, 5, 0, 0, 0]), "left": np.array([1, 3, -1, -1, -1]), "right": np.array([2, 4, -1, -1, -1]),
            "value": np.array([0.0, 0.0, 1.0, 2.0, 4.0]), "cover": np.array([8, 4, 4, 2, 2])}
    rows = np.array([[3, 5], [3, 6], [4, 0]], np.uint8)
    got = xp.shap_values([tree] * 9, rows, 2)
    assert np.allclose(got.sum(axis=1) + xp.expected([tree] * 9), 9 * np.array([2.0, 4.0, 1.0]))
    assert len(calls) == len(set(calls))


def test_leaves_are_valued_in_groups(monkeypatch):
    """The values don't depend on how many leaves a group has, nor on how many rows come at once; a group costs a row one lookup."""
    from sitewise.operators import trees as T

    rng = np.random.default_rng(4)
    codes = rng.integers(0, 60, (5000, 6)).astype(np.uint8)
    label = (codes[:, 0].astype(int) * codes[:, 1] + codes[:, 2] * 20 + rng.integers(0, 900, 5000) > 2200).astype(np.uint8)
    forest = [tree for _, tree in T.boosted(codes, label, np.zeros(5000, bool), np.arange(5000), {**bo.BASE_PARAMS, "n_estimators": 5}, None)]
    got = xp.shap_values(forest, codes, 6)
    assert sum(len(xp.grouped(tree)) for tree in forest) < 0.5 * sum(len(xp.leaves(tree)) for tree in forest)
    assert np.allclose(xp.expected(forest) + got.sum(axis=1), bo.margin_of(forest, codes), atol=1e-9)
    monkeypatch.setattr(xp, "GROUP_BITS", 0)  # each leaf alone
    assert np.allclose(xp.shap_values(forest, codes, 6), got, atol=1e-12)
    assert np.allclose(np.concatenate([xp.shap_values(forest, codes[i : i + 7], 6) for i in range(0, 70, 7)]), got[:70], atol=1e-12)
