"""The leaf-wise booster against a plain one, node by node; one block against many; search, patience, persistence."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.operators import booster as bo
from sitewise.operators import evaluate as ev
from sitewise.operators import trees as T

PARAMS = {"n_estimators": 6, "num_leaves": 8, "min_child_samples": 5, "colsample_bytree": 0.7}


def plain_tree(x, g, h, used, params):
    """Best-first growth by the definition: every bin of every node's rows tried anew; (feature, bin, left, right, sums) per node."""
    score = lambda a, b: max(abs(a) / T.SCALE - params["reg_alpha"], 0) ** 2 / (b / T.SCALE + params["reg_lambda"])
    sums = lambda rows: (g[rows].sum(), h[rows].sum(), float(len(rows)))

    def best(rows):
        top = None
        for f in used:
            for b in range(T.BINS - 1):
                lo, hi = rows[x[rows, f] <= b], rows[x[rows, f] > b]
                if min(len(lo), len(hi)) < params["min_child_samples"] or min(h[lo].sum(), h[hi].sum()) < T.LEAST_HESSIAN:
                    continue
                gain = score(*sums(lo)[:2]) + score(*sums(hi)[:2]) - score(*sums(rows)[:2])
                if gain > 0 and (top is None or gain > top[0] + 1e-9):
                    top = (gain, int(f), b, lo, hi)
        return top

    nodes = [[-1, 0, -1, -1, sums(np.arange(len(x)))]]
    leaves = {0: best(np.arange(len(x)))}
    while len(leaves) < params["num_leaves"] and any(leaves.values()):
        at = min((n for n, s in leaves.items() if s), key=lambda n: (-leaves[n][0], n))
        _, f, b, lo, hi = leaves.pop(at)
        nodes[at][:4] = f, b, len(nodes), len(nodes) + 1
        for rows in (lo, hi):
            leaves[len(nodes)] = best(rows)
            nodes.append([-1, 0, -1, -1, sums(rows)])
    return nodes


def test_trees_equal_the_plain_ones():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (300, 5)).astype(np.uint8)
    y = (x[:, 0] + x[:, 1] * 0.5 + rng.normal(0, 3, 300) > 9).astype(float)
    params = {**bo.BASE_PARAMS, **PARAMS, "n_estimators": 4}
    held = np.arange(300) % 6 == 0
    got = list(T.boosted(x, y.astype(np.uint8), held, np.arange(300), params, None))
    start = got[0][1]["value"][0]
    assert start == pytest.approx(np.log(y[~held].mean() / (1 - y[~held].mean())))
    margin, other = np.full((~held).sum(), start), np.full(held.sum(), start)
    for t, (area, tree) in enumerate(got[1:]):
        p = 1 / (1 + np.exp(-margin))
        want = plain_tree(x[~held], np.rint((p - y[~held]) * T.SCALE), np.rint(p * (1 - p) * T.SCALE), T.sampled(params, t, 5), params)
        assert [[int(tree[k][i]) for k in ("feature", "bin", "left", "right")] for i in range(len(want))] == [n[:4] for n in want]
        assert tree["cover"].tolist() == [n[4][2] for n in want]
        for i, (_, _, _, _, (g, h, _)) in enumerate(want):
            g, h = g / T.SCALE, h / T.SCALE
            assert tree["value"][i] == pytest.approx(-np.sign(g) * max(abs(g) - 0.1, 0) / (h + 0.1) * 0.05, abs=1e-12)
        for rows, m in ((x[~held], margin), (x[held], other)):
            for r in range(len(rows)):
                n = 0
                while want[n][0] >= 0:
                    n = want[n][2] if rows[r, want[n][0]] <= want[n][1] else want[n][3]
                m[r] += tree["value"][n]
        # held-out rows by rank, probabilities of one bucket being ties
        at = (1 / (1 + np.exp(-other)) * T.AUC_BUCKETS).astype(int)
        pairs = (at[y[held] == 1][:, None] > at[y[held] == 0][None]).mean() + (at[y[held] == 1][:, None] == at[y[held] == 0][None]).mean() / 2
        assert area == pytest.approx(pairs)


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(1200).select(
        n, (n % 97 + n % 13).cast("double").alias("a"), F.when(n % 11 != 0, (n * 7 % 101) / 10).alias("b"), F.when(n % 7 != 0, n % 4).alias("kind"),
        F.when(n % 50 == 3, F.lit("nan").cast("double")).otherwise((n * 31 % 17).cast("double")).alias("c"),
        (n % 5).cast("int").alias("fold"), ((n % 97 + n * 7 % 101 / 3 + F.xxhash64("id") % 20) > 70).cast("double").alias("label"))


def prepared(rows, **kw):
    return bo.prepare(rows, ["a", "b", "c"], ["kind"], "id", fold="fold", **kw)


def models():
    return [bo.Model(0, PARAMS), bo.Model(1, PARAMS, fold=0), bo.Model(2, {**PARAMS, "subsample_freq": 1, "subsample": 0.6, "num_leaves": 5}, fold=3), bo.Model(3, PARAMS, fold=2, patience=2)]


def table(fitted):
    return sorted((tuple(r[:2]), r["feature"], r["bin"], r["left"], r["right"], [round(v, 12) for v in r["value"]], r["cover"], r["area"]) for r in fitted.collect())


def test_one_block_and_many_give_the_same_models(rows):
    one, many = prepared(rows), prepared(rows, block_rows=250)
    assert one.n_blocks == 1 and many.n_blocks == 5 and many.blocks.count() == 5
    assert one.fills == many.fills
    a, b = bo.fit(one, models()), bo.fit(many, models())
    assert table(a) == table(b)
    assert bo.best_rounds(a, models()) == bo.best_rounds(b, models())
    x, y = (sorted(map(tuple, bo.held_out_scores(p, f, models()).collect())) for p, f in ((one, a), (many, b)))
    assert x == y


def test_held_out_scores_and_areas(rows):
    p = prepared(rows)
    own = models()[1:3]
    fitted = bo.fit(p, own)
    scores = bo.held_out_scores(p, fitted, own)
    assert {r["model"]: r["n"] for r in scores.groupBy("model").agg(F.count("*").alias("n")).collect()} == {1: 240, 2: 240}
    areas = {r["model"]: r["auc_roc"] for r in ev.auc(scores, groups=["model"]).collect()}
    ends = bo.best_rounds(fitted, own)
    assert all(abs(areas[i] - ends[i][1]) < 1e-2 for i in areas)


def test_a_fold_is_judged_by_its_own_training_rows(spark):
    # category 9 occurs in fold 1 alone, and fold 0 has another median than the rest
    rows = spark.createDataFrame([(i, float(i % 10) if i % 2 else 100.0 + i, 9 if i % 2 and i % 3 == 0 else i % 3, i % 2, float(i % 4 == 1)) for i in range(200)], "id long, a double, kind int, fold int, label double")
    p = bo.prepare(rows, ["a"], ["kind"], "id", fold="fold")
    even, odd = [100.0 + i for i in range(0, 200, 2)], [float(i % 10) for i in range(1, 200, 2)]
    assert p.fills[0][0] == np.median(odd) and p.fills[1][0] == np.median(even) and p.fills[-1][0] == np.median(even + odd)
    block = bo.Block(p.blocks.first(), 2)
    raw = {int(k): v for k, v in zip(block.keys, block.codes[1], strict=True)}
    view = bo.View(block, bo.Model(0, fold=1), p.fill_bins(1), [1])
    kinds = {r["k"]: (r["kind"], r["fold"]) for r in rows.select(F.xxhash64("id").alias("k"), "kind", "fold").collect()}
    for key, code in zip(block.keys, view.codes[:, 1], strict=True):
        assert code == (0 if kinds[int(key)][0] == 9 else raw[int(key)]) and raw[int(key)] > 0


def test_scoring_saving_loading_and_metadata(spark, rows, tmpdir_path):
    p = prepared(rows)
    fitted = bo.fit(p, [bo.Model(0, PARAMS)])
    model = bo.trained(p, fitted, bo.Model(0, PARAMS))
    odd = rows.where("id < 3").withColumns({"id": F.col("id") + 10_000, "kind": F.lit(77).cast("bigint"), "a": F.lit(None).cast("double")})
    scored = model.transform(rows.unionByName(odd)).select("id", "prob", "features").collect()
    assert len(scored) == 1203 and all(0 < r.prob < 1 for r in scored)
    assert all(r.features[0] == p.fills[-1][0] and r.features[3] == -1.0 for r in scored if r.id >= 10_000)
    # the training rows' margins again, from the trees by raw thresholds
    for r in scored[:50]:
        m = 0.0
        for tree in model.forest:
            n = 0
            while tree["feature"][n] >= 0:
                f = tree["feature"][n]
                n = tree["left"][n] if r.features[f] <= model.cuts[f][tree["bin"][n]] else tree["right"][n]
            m += tree["value"][n]
        assert r.prob == pytest.approx(1 / (1 + np.exp(-m)), abs=1e-12)
    path = f"{tmpdir_path}/saved"
    bo.save(spark, model, path, {"threshold": 0.4})
    assert bo.merge_metadata(spark, path, {"serving_threshold": 0.6, "auc": 0.9}) == {"threshold": 0.4, "serving_threshold": 0.6, "auc": 0.9}
    again, meta = bo.load(spark, path)
    assert meta["serving_threshold"] == 0.6 and again.n_trees == 6
    assert {r.id: r.prob for r in again.transform(rows).collect()} == {r.id: r.prob for r in scored if r.id < 10_000}
    with pytest.raises(FileNotFoundError):
        bo.load(spark, f"{tmpdir_path}/absent")


def test_search_tries_every_draw_and_stops_early(rows):
    p = prepared(rows)
    draws = [{**d, "n_estimators": 30} for d in bo.random_draws(3)]
    found = bo.search(p, draws, patience=3)
    assert [r["trial"] for r in found] == [0, 1, 2] and sum(r["best"] for r in found) == 1
    assert all(len(r["trees"]) == 5 and max(r["trees"]) <= 30 for r in found)
    assert len(bo.random_draws()) == 50 and json.dumps(bo.random_draws()) == json.dumps(bo.random_draws())
    assert [r["trial"] for r in bo.search(p, draws, patience=3, seconds=-1)] == [0, 1, 2]  # the first wave always runs


def test_search_tries_every_draw_however_long_it_takes(rows, monkeypatch):
    clock = iter(range(0, 10**9, 10**6))  # a wave seems to take eleven days
    monkeypatch.setattr(bo.time, "monotonic", lambda: float(next(clock)))
    monkeypatch.setattr(bo, "WAVE", 1)
    draws = [{**d, "n_estimators": 2} for d in bo.random_draws(3)]
    assert [r["trial"] for r in bo.search(prepared(rows), draws, patience=2)] == [0, 1, 2]


def test_a_feature_without_values_is_an_error(rows):
    with pytest.raises(ValueError, match="c"):
        bo.prepare(rows.withColumn("c", F.lit(None).cast("double")), ["a", "c"], ["kind"], "id")


def test_many_blocks_take_a_stage_a_round(rows, spark, monkeypatch):
    # one stage a round and few rounds a tree, with margins carried on past a checkpoint and sums added up by tasks
    monkeypatch.setattr(bo, "LINEAGE_TREES", 2)
    monkeypatch.setattr(bo, "DRIVER_BYTES", 1 << 16)
    one, many = prepared(rows), prepared(rows, block_rows=250)
    assert table(bo.fit(one, models())) == table(bo.fit(many, models()))
    monkeypatch.setattr(bo, "DRIVER_BYTES", 1 << 30)
    group = "booster-rounds"
    spark.sparkContext.setJobGroup(group, "rounds")
    bo.fit(many, [bo.Model(0, PARAMS)])
    spark.sparkContext.setJobGroup("other", "other")
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    assert len(jobs) <= 12 * PARAMS["n_estimators"]
    assert sum(1 for j in jobs if len(tracker.getJobInfo(j).stageIds) <= 2) >= 0.8 * len(jobs)


@pytest.mark.parametrize("n", [300, T.MANY_ROWS + 5, 16 * T.MANY_ROWS + 3])
@pytest.mark.parametrize("width", [1, 4, 5])
def test_histograms_by_pairs_of_features(n, width):
    rng = np.random.default_rng(n + width)
    codes = rng.integers(0, T.BINS, (width, n)).astype(np.uint8)
    g, h = rng.integers(-(1 << 24), 1 << 24, n).astype(float), rng.integers(0, 1 << 22, n).astype(float)
    columns = T.Columns(codes)
    for rows in (np.arange(n), np.flatnonzero(codes[0] < 9), np.arange(7)):
        want = np.zeros((3, width, T.BINS))
        for f in range(width):
            for k, w in enumerate((g[rows], h[rows], np.ones(len(rows)))):
                np.add.at(want[k, f], codes[f][rows], w)
        assert (columns.histogram(rows, g, h) == want).all()
    nodes = np.arange(n) % 3
    both = T.node_histograms(np.ascontiguousarray(codes.T), nodes, [2, 0], np.arange(width), g, h)
    assert (both[0] == columns.histogram(np.flatnonzero(nodes == 2), g, h)).all() and (both[1] == columns.histogram(np.flatnonzero(nodes == 0), g, h)).all()


def test_masks_give_the_margins_of_routing_to_the_last_bit():
    rng = np.random.default_rng(3)
    rows = T.Masks.ROWS + 700
    codes = rng.integers(0, T.BINS - 1, (rows, 5)).astype(np.uint8)
    label = (codes[:, 0].astype(int) * codes[:, 1] + rng.integers(0, 900, rows) > 1400).astype(np.uint8)
    for leaves in (2, 31, 64, 90):  # more than 64 are routed
        params = {**bo.BASE_PARAMS, "n_estimators": 6, "num_leaves": leaves}
        forest = [tree for _, tree in T.boosted(codes, label, np.zeros(rows, bool), np.arange(rows), params, None)]
        assert max((tree["feature"] < 0).sum() for tree in forest) == leaves
        odd = codes.copy()
        odd[:50, 0] = T.MISSING  # above every cut
        routed = np.zeros(rows)
        for tree in forest:
            routed += tree["value"][T.routed(tree, odd)]
        assert (bo.margin_of(forest, odd) == routed).all()
        assert (T.Masks(forest).margin(odd[:0]) == routed[:0]).all()


@pytest.mark.parametrize("heavy", [1.0, 40.0, 1e6])
def test_hessians_and_rows_from_one_sum(heavy):
    """Sums of several parts, and hessians so large that the rows are counted apart."""
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 64, (3, 90_000)).astype(np.uint8)
    g, h = np.rint(rng.normal(0, heavy * T.SCALE, 90_000)), np.rint(rng.random(90_000) * heavy * T.SCALE / 4)
    sums = T.Sums(g, h)
    assert (len(sums.weights) == 2) == (heavy < 1e3)
    for rows in (None, np.arange(0, 90_000, 2), np.arange(500)):
        some = slice(None) if rows is None else rows
        want = [[np.bincount(c[some], None if w is None else w[some], 64) for c in codes] for w in (g, h, None)]
        assert (T.Columns(codes).histogram(rows, g, h) == want).all()


def test_rows_inside_of_regions_and_their_histograms():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, T.BINS - 1, (5, 40_000)).astype(np.uint8)
    label = (codes[0].astype(int) * codes[1] + rng.integers(0, 900, 40_000) > 1400).astype(float)
    g, h = T.gradients(rng.normal(0, 1, 40_000), label, bo.BASE_PARAMS)
    used = np.array([0, 1, 2, 4])
    model = bo.Model(0, {"num_leaves": 100})
    growth = bo.Growth(model, used)
    nodes, rounds = [0], 0
    while nodes:  # as the rounds ask for them
        at = T.inside(growth.regions(nodes), codes)
        want = np.zeros(40_000, int) if growth.ahead is None else T.routed(growth.ahead.arrays(model["params"]), codes.T)
        assert (at == np.select([want == n for n in nodes], range(len(nodes)), -1)).all()
        own = np.flatnonzero(at >= 0)
        hists = T.histograms([codes[f].take(own) for f in used], at.take(own), len(nodes), g[own], h[own])
        for k in range(len(nodes)):
            rows = np.flatnonzero(at == k)
            assert (hists[k] == T.Columns(codes[used]).histogram(rows, g, h)).all()
        growth.take({n: hists[k].astype(float) for k, n in enumerate(nodes)})
        nodes, rounds = growth.wanted(), rounds + 1
    one, _ = T.grown(codes[used], g, h, used, model["params"])
    a, b = growth.settled()[0].arrays(model["params"]), one.arrays(model["params"])
    assert rounds < 30 and all((a[k] == b[k]).all() for k in a)
    many = [{0: (k // 10 * 6 - 1, k // 10 * 6 + 5), 1: (k % 10 * 6 - 1, k % 10 * 6 + 5)} for k in range(100)]  # more than a word has bits
    at = T.inside(many, codes)
    assert (at == np.where((codes[0] < 60) & (codes[1] < 60), codes[0].astype(int) // 6 * 10 + codes[1] // 6, -1)).all()


def test_a_round_sends_what_it_asks_for_alone(rows, spark, monkeypatch):
    sizes, dumps = [], bo.cloudpickle.dumps
    mapped = bo.RDD.map
    monkeypatch.setattr(bo.RDD, "map", lambda self, f, *a, **kw: sizes.append(len(dumps(f))) or mapped(self, f, *a, **kw))
    bo.fit(prepared(rows, block_rows=250), [bo.Model(0, PARAMS)])
    assert len(sizes) > 3 * PARAMS["n_estimators"] and sorted(sizes)[-3] < 8000  # all but the two that read the blocks


def test_blocks_are_larger_where_there_is_one_model(rows, monkeypatch):
    monkeypatch.setattr(bo, "BLOCK_ROWS", 250)
    monkeypatch.setattr(bo, "ONE_MODEL_ROWS", 1300)
    assert prepared(rows).n_blocks == 5 and bo.prepare(rows, ["a", "b", "c"], ["kind"], "id").n_blocks == 1
    monkeypatch.setattr(bo, "ONE_MODEL_ROWS", 600)
    assert bo.prepare(rows, ["a", "b", "c"], ["kind"], "id").n_blocks == 2
