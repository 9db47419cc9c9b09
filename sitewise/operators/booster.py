"""Boosted trees over binned rows (D1-D4, M1-M5, S6, S7): preparation, training of many models at once, scoring.

**Preparation** happens once for all models.  Every feature gets up to 62 cuts; rows are
dealt by a hash of their key over blocks of about ``BLOCK_ROWS`` rows, each one row of a
written table that holds a byte per row and feature.  What differs between the folds
(exact medians, modes, categories not seen in training) is a handful of bins per model,
put in when a task reads the block, so no fold is prepared anew.

**Training** takes a list of models (parameters, held-out fold, patience).  Where the rows
fill one block (without folds, of one model, a larger one), a task trains a model whole, and the models spread over the tasks.  Where
there are more blocks, all models grow together: a round is one Spark job of one stage that
sums the histograms of all models' open nodes over all blocks, so the number of jobs depends
neither on models nor on rows.  A tree's rounds go on until
every leaf that can be the next one to split is known, and then keep the splits in order
of their gain; margins are part of a persisted state, checkpointed every few trees.
Histograms are integers, hence both ways give the same trees.

The row share ``subsample`` only works with ``subsample_freq`` above 0, as in the studied
library, whose defaults leave it idle.
"""

from __future__ import annotations

import functools
import json
import math
import random
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import with_derived
from ..schema import RANDOM_STATE
from ..session import ensure_checkpoint_dir, written
from . import ranking, selection, trees
from .evaluate import class_weights
from .joins import bounded_broadcast

# ---- fixed values: base parameters, search ranges and budget ---------------
BASE_PARAMS = {"n_estimators": 500, "learning_rate": 0.05, "num_leaves": 31, "min_child_samples": 20, "subsample": 0.8,
               "subsample_freq": 0, "colsample_bytree": 0.8, "reg_alpha": 0.1, "reg_lambda": 0.1, "random_state": RANDOM_STATE,
               "class_weight": (1.0, 1.0)}
SEARCH_SPACE = {"num_leaves": (15, 127, "int"), "learning_rate": (0.01, 0.15, "log"), "n_estimators": (200, 1000, "int"),
                "min_child_samples": (10, 60, "int"), "subsample": (0.6, 1.0, "lin"), "colsample_bytree": (0.6, 1.0, "lin"),
                "reg_alpha": (1e-3, 1.0, "log"), "reg_lambda": (1e-3, 1.0, "log")}
TRIALS, PATIENCE = 50, 50
DEFAULT_THRESHOLD = 0.5
# -----------------------------------------------------------------------------
#: rows that one task trains on; up to here its work on a tree takes less than the jobs of a tree's rounds
BLOCK_ROWS = 1_000_000
#: the same where there are no folds, hence one model, for which a round is mostly overhead; some 230 bytes a row in a task
ONE_MODEL_ROWS = 6_000_000
LEAST_BLOCK_ROWS = 20_000
#: trees after which the state of many blocks is checkpointed, and tree rows that the driver holds before they are written
LINEAGE_TREES, KEPT_TREES = 25, 5_000
#: sums of a round that the driver adds up itself; larger ones are added by tasks first
DRIVER_BYTES = 64 << 20
#: trials trained together
WAVE = 10

TREES = "model int, tree int, area double, feature array<int>, bin array<int>, left array<int>, right array<int>, value array<double>, cover array<bigint>"
BLOCK = "block int, n int, codes binary, label binary, fold binary, seen binary, keys binary"


def balanced(train: DataFrame, label: str = "label") -> dict:
    """A parameter that weighs the classes by n / (2 n_class)."""
    weights = {int(r[label]): r["weight"] for r in class_weights(train, label).collect()}  # a row a class
    return {"class_weight": (weights.get(0, 1.0), weights.get(1, 1.0))}


class Model(dict):
    """What to train: id, params, fold (held out; -1: none) and patience (None: all trees)."""

    def __init__(self, id: int, params: dict | None = None, fold: int = -1, patience: int | None = None):  # noqa: A002
        super().__init__(id=id, params={**BASE_PARAMS, **(params or {})}, fold=fold, patience=patience)


def known(name: str) -> Column:
    """A feature as a double; NaN is missing."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


class Prepared:
    """Binned blocks of the training rows and, per held-out fold (-1: none), what fills the gaps."""

    def __init__(self, numeric: list[str], categorical: list[str], blocks: DataFrame, n_blocks: int, cuts: list[np.ndarray],
                 fills: dict[int, list[float]], categories: dict[str, DataFrame], folds: list[int]):
        self.numeric, self.categorical, self.blocks, self.n_blocks = numeric, categorical, blocks, n_blocks
        self.cuts, self.fills, self.categories, self.folds = cuts, fills, categories, folds

    @property
    def names(self) -> list[str]:
        return self.numeric + self.categorical

    def fill_bins(self, fold: int) -> list[int]:
        return [int(np.searchsorted(c, v)) for c, v in zip(self.cuts, self.fills[fold], strict=True)]


def _sets(counts: DataFrame, folds: list[int]) -> DataFrame:
    """Counts by fold as counts of the training sets: all rows (-1) and all but each fold."""
    others = F.filter(F.array(*[F.lit(f) for f in [-1, *folds]]), lambda f: f != F.col("_fold"))
    keep = [c for c in counts.columns if c not in ("_fold", "cnt")]
    return counts.withColumn("set", F.explode(others)).groupBy("set", *keep).agg(F.sum("cnt").alias("cnt"))


def _modes(base: DataFrame, col: str, folds: list[int]) -> dict[int, float]:
    """The most frequent category code of each training set, the least one on ties."""
    counts = _sets(base.where(F.col(col).isNotNull()).groupBy("_fold", col).agg(F.count("*").alias("cnt")), folds)
    top = counts.groupBy("set").agg(F.max(F.struct("cnt", (-F.col(col)).alias("code"))).alias("top"))
    return {r["set"]: -r["top"]["code"] for r in top.collect()}


def _packed(names: list[str], cuts: list[np.ndarray], seen: list[str]):  # noqa: ANN202
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, found = 0, {c: [] for c in ("codes", "label", "fold", "seen", "keys")}
        for rows in batches:  # no more than a batch at a time is wider than its bytes
            if not len(rows):
                continue
            block, codes = int(rows["_block"].iloc[0]), np.empty((len(names), len(rows)), np.uint8)
            for i, (name, cut) in enumerate(zip(names, cuts, strict=True)):
                x = rows[name].to_numpy(float)
                codes[i] = np.where(np.isnan(x), trees.MISSING, np.searchsorted(cut, x))
            found["codes"].append(codes)
            found["label"].append(rows["_label"].to_numpy(np.uint8))
            found["fold"].append(rows["_fold"].to_numpy(np.int8))
            found["seen"].append(np.array([rows[s].fillna(0).to_numpy(np.int64) for s in seen], np.int64).reshape(len(seen), -1))
            found["keys"].append(rows["_key"].to_numpy(np.int64))
        n = sum(map(len, found["label"]))
        if n:
            yield pd.DataFrame({"block": [block], "n": [n], **{c: [np.concatenate(found.pop(c), axis=-1).tobytes()] for c in list(found)}})

    return pack


def prepare(train: DataFrame, numeric: list[str], categorical: list[str], key: str, label: str = "label", fold: str | None = None,
            block_rows: int | None = None) -> Prepared:
    """Bin the labelled rows of ``train``.  A feature without any value in a training set is an error (trap 26).

    key: a column that identifies a row; fold: its fold, below 63 (None: no folds); block_rows:
    rows of a block at most, on average.
    """
    block_rows = block_rows or (BLOCK_ROWS if fold else ONE_MODEL_ROWS)
    ready = with_derived(train, refresh=True)
    folded = F.col(fold).cast("int") if fold else F.lit(-2)  # a row of no fold is held out by no model
    base = ready.select(F.xxhash64(key).alias("_key"), F.col(label).cast("int").alias("_label"), folded.alias("_fold"), *[known(c).alias(c) for c in numeric + categorical])
    base = written(base, "training-rows")
    raw, tables = base, {}
    for c in categorical:
        # D3: sorted categories as a table, with a bit for each fold that has one
        bits = raw.where(F.col(c).isNotNull()).groupBy(c).agg(F.bit_or(F.expr("shiftleft(1L, greatest(_fold, 0))")).alias("seen"), F.lit(1).cast("long").alias("cnt"))
        coded = ranking.positions(bits, [], c).select(c, F.col("before").cast("double").alias("code"), "seen")
        tables[c] = written(coded, "categories")
        named = bounded_broadcast(tables[c].withColumnsRenamed({"code": f"{c}__code", "seen": f"{c}__seen"}))
        base = base.join(named, c, "left").drop(c).withColumnRenamed(f"{c}__code", c)
    names = numeric + categorical
    steps = [i / (trees.BINS - 1) for i in range(1, trees.BINS - 1)]
    found = base.agg(F.count("*").alias("_n"), F.collect_set("_fold").alias("_folds"), *[F.percentile_approx(c, steps, 10_000).alias(c) for c in names]).first()
    n = found["_n"]
    if not n:
        raise ValueError("no labelled rows to train on")
    folds = sorted(found["_folds"]) if fold else []  # below 63 of them
    cuts = [np.unique(np.array(found[c] or [], float)) for c in numeric]
    # a code's bin is above the one of categories that training didn't see
    cuts += [np.unique(np.concatenate([[-0.5], np.array(found[c] or [], float)])) for c in categorical]

    fills: dict[int, list[float]] = {}
    # Exact medians of all rows and of those outside each fold
    middles = selection.quantiles(raw, numeric, [0.5], "_fold", {-1: None, **{f: [g for g in folds if g != f] for f in folds}})
    modes = {c: _modes(base, c, folds) for c in categorical}
    for s in [-1, *folds]:
        got = {**{c: middles[s, c].quantile(0.5) for c in numeric}, **{c: modes[c].get(s) for c in categorical}}
        empty = [c for c in names if got.get(c) is None]
        if empty:
            raise ValueError(f"cannot impute all-null column(s): {empty}")
        fills[s] = [float(got[c]) for c in names]

    n_blocks = -(-n // block_rows)
    if n_blocks > 1:  # a model doesn't depend on the blocks: one for each core, if they are large enough
        n_blocks = max(n_blocks, min(train.sparkSession.sparkContext.defaultParallelism, n // LEAST_BLOCK_ROWS))
    dealt = base.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(n_blocks)).cast("int"))
    pack = _packed(names, cuts, [f"{c}__seen" for c in categorical])
    by_block = dealt.groupBy("_block").applyInPandas(lambda rows: next(pack(iter([rows]))), BLOCK) if n_blocks > 1 else dealt.coalesce(1).mapInPandas(pack, BLOCK)
    return Prepared(numeric, categorical, written(by_block, "blocks"), n_blocks, cuts, fills, tables, folds)


class Block:
    """Arrays of one row of the block table."""

    def __init__(self, row, features: int):  # noqa: ANN001
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(features, -1)
        self.label, self.fold = np.frombuffer(row["label"], np.uint8), np.frombuffer(row["fold"], np.int8)
        self.keys = np.frombuffer(row["keys"], np.int64) if row["keys"] else None
        self.seen = np.frombuffer(row["seen"], np.int64).reshape(-1, len(self.label)) if row["seen"] else np.zeros((0, len(self.label)), np.int64)


class View:
    """A block as one model sees it."""

    def __init__(self, block: Block, model: dict, fills: list[int], categorical: list[int]):
        self.codes = trees.filled(block.codes, block.seen, model["fold"], fills, categorical)
        self.held = block.fold == model["fold"] if model["fold"] >= 0 else np.zeros(len(block.label), bool)
        self.label, self.keys = block.label, block.keys


def _plan(p: Prepared, models: list[dict]) -> tuple[dict[int, dict], dict[int, list[int]], list[int], int]:
    """What tasks need of the models: themselves, their fills, the places of the categorical features, the number of features."""
    places = [len(p.numeric) + i for i in range(len(p.categorical))]
    return {m["id"]: m for m in models}, {f: p.fill_bins(f) for f in {m["fold"] for m in models}}, places, len(p.names)


def _tree_row(model: int, tree: int, area: float | None, nodes: dict) -> dict:
    return {"model": model, "tree": tree, "area": area, **{k: v.tolist() for k, v in nodes.items()}}


def _fit_in_tasks(p: Prepared, models: list[dict]) -> DataFrame:
    """One block: a task trains a model."""
    by_id, fills, places, features = _plan(p, models)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                m = by_id[row["model"]]
                v = View(Block(row, features), m, fills[m["fold"]], places)
                rounds = trees.boosted(v.codes, v.label, v.held, v.keys, m["params"], m["patience"])
                yield pd.DataFrame([_tree_row(m["id"], t - 1, area, nodes) for t, (area, nodes) in enumerate(rounds)])

    jobs = p.blocks.withColumn("model", F.explode(F.array(*[F.lit(i) for i in by_id])))
    return written(jobs.repartitionByRange(len(models), "model").mapInPandas(fit, TREES), "trees")


class Growth:
    """A tree of one model while its histograms come from Spark jobs.

    Splits are made ahead of their turn in ``ahead``; ``settled`` takes them in order of
    their gain and says which nodes must be known first.  Of two children one is counted,
    the other is the parent less it; a node's histogram is kept until its children have theirs.
    """

    def __init__(self, model: dict, used: np.ndarray):
        self.model, self.used, self.ahead, self.splits = model, used, None, {}
        self.hists: dict[int, np.ndarray] = {}
        self.siblings: dict[int, int] = {}  # the other child of a node
        self.parent: dict[int, int] = {}

    def wanted(self) -> list[int]:
        """The nodes to count: all that must be known, but of two children the lighter one."""
        if self.ahead is None:
            return [0]
        rows = [s[2] for s in self.ahead.sums]
        return sorted({min(a, self.siblings[a], key=lambda x: (rows[x], x)) for a in self.settled()[1]})

    def take(self, found: dict[int, np.ndarray]) -> None:
        """Histograms (3, used features, bins) of the nodes that were asked for."""
        hists = dict(found)
        for node, hist in found.items():
            if node:
                hists[self.siblings[node]] = self.hists.pop(self.parent[node]) - hist
        if self.ahead is None:
            self.ahead = trees.Tree(hists[0][:, 0].sum(axis=1))
        nodes = sorted(hists)
        for node, split in zip(nodes, trees.best_splits(np.stack([hists[n] for n in nodes]), self.used, self.model["params"]), strict=True):
            self.splits[node] = split
            if split:
                one, other = self.ahead.split(node, split)
                self.siblings.update({one: other, other: one})
                self.parent.update({one: node, other: node})
                self.hists[node] = hists[node]

    def regions(self, nodes: list[int]) -> list[trees.Region]:
        """What leads to some nodes ahead."""
        out = []
        for node in nodes:
            region: trees.Region = {}
            while node:
                above = self.parent[node]
                f, cut = self.ahead.feature[above], self.ahead.bin[above]
                low, high = region.get(f, (-1, 255))
                region[f] = (low, min(high, cut)) if self.ahead.left[above] == node else (max(low, cut), high)
                node = above
            out.append(region)
        return out

    def settled(self) -> tuple[trees.Tree, list[int]]:
        limit, params = self.model["params"]["num_leaves"], self.model["params"]
        tree = trees.Tree(self.ahead.sums[0])
        open_nodes = {0: 0}  # node of the tree -> node ahead
        leaves = 1
        while leaves < limit:
            unknown = [a for a in open_nodes.values() if a not in self.splits]
            if unknown:
                return tree, unknown
            best = min(((-self.splits[a][0], n, a) for n, a in open_nodes.items() if self.splits[a]), default=None)
            if best is None:
                break
            _, node, at = best
            del open_nodes[node]
            for new, old in zip(tree.split(node, self.splits[at]), (self.ahead.left[at], self.ahead.right[at]), strict=True):
                open_nodes[new] = old
            leaves += 1
            # its children must be known before the next choice, and so must those that stand next in line
            if leaves < limit:
                unknown = [a for a in open_nodes.values() if a not in self.splits]
                if unknown:
                    line = sorted((-self.splits[a][0], a) for a in open_nodes.values() if self.splits.get(a))[: limit - leaves]
                    nearer = [c for _, a in line for c in (self.ahead.left[a], self.ahead.right[a]) if c not in self.splits]
                    return tree, unknown + nearer
        return tree, []


class Rounds:
    """What tasks do in the rounds of many models' training.

    It travels to the tasks once, as a broadcast; a round sends what it asks for.
    """

    def __init__(self, p: Prepared, models: list[dict], starts: dict[int, float]):
        self.by_id, self.fills, self.places, self.features = _plan(p, models)
        self.order, self.starts = {i: k for k, i in enumerate(self.by_id)}, starts

    def first(self, row: dict) -> dict:
        return {**row, "margins": [np.full(len(row["label"]), self.starts[i]) for i in self.by_id]}

    def views(self, block: Block, models: Iterable[int]) -> dict[int, np.ndarray]:
        """The block's codes (features, rows) as the models of each fold see them."""
        return {f: trees.filled_columns(block.codes, block.seen, f, self.fills[f], self.places) for f in {self.by_id[i]["fold"] for i in models}}

    def moved(self, row: dict, done: dict[int, dict]) -> dict:
        """The state with a tree of each model more."""
        block, margins = Block(row, self.features), list(row["margins"])
        views = self.views(block, done)
        for i, tree in done.items():
            margins[self.order[i]] = margins[self.order[i]] + trees.Masks([tree]).margin_of(views[self.by_id[i]["fold"]])
        return {**row, "margins": margins}

    def count(self, row: dict, asked: dict[int, list[trees.Region]], used: dict[int, np.ndarray], t: int, judged: list[int]) -> tuple[dict, dict]:
        """Histograms of the asked nodes, and counts for the area under the curve of the judged models."""
        block, hists, counts = Block(row, self.features), {}, {}
        views = self.views(block, asked)
        for i, regions in asked.items():
            m = self.by_id[i]
            codes, margin, label = views[m["fold"]], row["margins"][self.order[i]], block.label
            at = trees.inside(regions, codes)
            bag = trees.in_bag(m["params"], t, block.keys)
            if m["fold"] >= 0:
                at[block.fold == m["fold"]] = -1
            if bag is not None:
                at[~bag] = -1
            own = np.flatnonzero(at >= 0)
            columns = [codes[f] for f in used[i]]
            if len(own) < len(at):
                at, margin, label, columns = at.take(own), margin.take(own), label.take(own), [c.take(own) for c in columns]
            g, h = trees.gradients(margin, label.astype(float), m["params"])
            hists[i] = trees.histograms(columns, at, len(regions), g, h)
        for i in judged:
            held = block.fold == self.by_id[i]["fold"]
            n = trees.auc_counts(row["margins"][self.order[i]][held], block.label[held]).ravel()
            at = np.flatnonzero(n)
            counts[i] = at.astype(np.int32), n[at]
        return hists, counts


def _sent(spark: SparkSession, value: object):  # noqa: ANN202
    """``value`` for all tasks: a function (method, arguments) -> the function of a row that calls this method of it.

    The package's code travels with ``value`` once, and a worker unpacks it once; what a job sends besides is small.
    """
    kept, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    def calling(method: str, *args):  # noqa: ANN002, ANN202
        def call(row):  # noqa: ANN001, ANN202
            import pickle
            import sys

            unpacked = sys.__dict__.setdefault("_sitewise_sent", {})
            if key not in unpacked:
                unpacked.clear()
                unpacked[key] = pickle.loads(kept.value)
            return getattr(unpacked[key], method)(row, *args)

        return call

    return calling


def _fit_in_rounds(p: Prepared, models: list[dict]) -> DataFrame:
    """Many blocks: all models grow together, a job of one stage a round.

    A task counts the open nodes' histograms of its block; their size follows the models
    alone, and the driver adds them up and splits.  The margins are part of a persisted
    state, which takes in a tree with the first round of the next one.
    """
    spark = p.blocks.sparkSession
    by_id, fills, _, features = _plan(p, models)

    positive = {f: [0, 0] for f in fills}
    # what no model needs stays out of the state
    columns = ["codes", "label", "fold", *(["seen"] if max(fills) >= 0 else []), *(["keys"] if any(m["params"]["subsample_freq"] for m in models) else [])]
    blocks = p.blocks.rdd.map(lambda r: (r["block"], {**dict.fromkeys(("seen", "keys")), **{c: bytes(r[c]) if r[c] is not None else None for c in columns}})).partitionBy(p.n_blocks, int)
    counted = blocks.values().flatMap(lambda r: [(int(f), int((b.fold == f).sum()), int(b.label[b.fold == f].sum())) for b in [Block(r, features)] for f in np.unique(b.fold)])
    for fold, n, yes in counted.collect():  # a row a block and fold
        for f, sums in positive.items():
            if fold != f or f < 0:
                sums[0], sums[1] = sums[0] + yes, sums[1] + n
    starts = {i: trees.start_margin(*positive[m["fold"]], m["params"]) for i, m in by_id.items()}
    leaf = lambda v, n: {"feature": np.array([-1]), "bin": np.array([0]), "left": np.array([-1]), "right": np.array([-1]), "value": np.array([v]), "cover": np.array([n])}
    kept, waiting = [], [_tree_row(i, -1, None, leaf(starts[i], positive[m["fold"]][1])) for i, m in by_id.items()]

    def keep() -> None:
        kept.append(written(spark.createDataFrame(waiting, TREES), "trees"))
        waiting.clear()

    tasks = _sent(spark, Rounds(p, models, starts))

    def round_of(state: RDD, asked: dict[int, list[trees.Region]], used: dict[int, np.ndarray], t: int, judged: list[int]) -> tuple[dict, dict]:
        """Histograms of the asked nodes, and counts for the area under the curve of the judged models."""

        def added(one: tuple[dict, dict], other: tuple[dict, dict]) -> tuple[dict, dict]:
            counts = {}
            for i in judged:
                at, where = np.unique(np.concatenate([one[1][i][0], other[1][i][0]]), return_inverse=True)
                n = np.zeros(len(at), np.int64)
                np.add.at(n, where, np.concatenate([one[1][i][1], other[1][i][1]]))
                counts[i] = at, n
            return {i: one[0][i] + other[0][i] for i in asked}, counts

        parts = state.map(tasks("count", asked, {i: used[i] for i in asked}, t, judged))
        size = 8 * (3 * trees.BINS * sum(len(nodes) * len(used[i]) for i, nodes in asked.items()) + 2 * trees.AUC_BUCKETS * len(judged))
        if size * p.n_blocks > DRIVER_BYTES:
            return parts.treeReduce(added)
        return functools.reduce(added, parts.collect())

    def area(counts: tuple[np.ndarray, np.ndarray]) -> float | None:
        n = np.zeros(2 * trees.AUC_BUCKETS, np.int64)
        n[counts[0]] = counts[1]
        return trees.auc_of(n.reshape(2, -1))

    ensure_checkpoint_dir(spark)
    state = blocks.values().map(tasks("first")).persist(StorageLevel.MEMORY_AND_DISK)
    base, before = [], []
    alive, stops, done = set(by_id), {i: trees.Patience(m["patience"]) for i, m in by_id.items()}, {}
    for t in range(max(m["params"]["n_estimators"] for m in models) + 1):
        judged = [i for i in done if by_id[i]["fold"] >= 0]
        growing = {i for i in alive if t < by_id[i]["params"]["n_estimators"]}
        used = {i: trees.sampled(by_id[i]["params"], t, features) for i in growing}
        growths = {i: Growth(by_id[i], used[i]) for i in growing}
        asked = {i: [0] for i in growing}
        if not asked and not judged and not done:
            break
        areas: dict[int, float | None] = {}
        while asked or judged:
            hists, counts = round_of(state, {i: growths[i].regions(nodes) for i, nodes in asked.items()}, used, t, judged)
            if judged:
                areas, judged = {i: area(counts[i]) for i in judged}, []
            if done:  # the tree before, whose areas came with this round
                waiting.extend(_tree_row(i, t - 1, areas.get(i), tree) for i, tree in done.items())
                alive = {i for i in growing if not stops[i].ends(t - 1, areas.get(i))}
                done = {}
            for i in asked:
                if i in alive:
                    growths[i].take({n: hists[i][k].astype(float) for k, n in enumerate(asked[i])})
            asked = {i: w for i in asked if i in alive and (w := growths[i].wanted())}
        if done:
            waiting.extend(_tree_row(i, t - 1, None, tree) for i, tree in done.items())
            done = {}
        alive &= growing
        for old in before:
            old.unpersist()
        before = []
        if len(waiting) > KEPT_TREES:
            keep()
        if not alive:
            break
        done = {i: growths[i].settled()[0].arrays(by_id[i]["params"]) for i in alive}

        before = [state]
        state = state.map(tasks("moved", done)).persist(StorageLevel.MEMORY_AND_DISK)
        if t % LINEAGE_TREES == LINEAGE_TREES - 1:
            state.checkpoint()
            state.foreach(lambda row: None)
            for old in base:
                forget_folder(spark, old)
            base = [state.getCheckpointFile()]
    state.unpersist()
    for old in base:
        forget_folder(spark, old)
    if waiting:
        keep()
    return functools.reduce(DataFrame.unionByName, kept)


def forget_folder(spark: SparkSession, folder: str) -> None:
    """Delete a checkpoint that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fit(p: Prepared, models: list[dict]) -> DataFrame:
    """The trees of all models: a row a tree, in which tree -1 is the start; ``area`` is the AUC on the held-out fold so far."""
    return _fit_in_tasks(p, models) if p.n_blocks == 1 else _fit_in_rounds(p, models)


def best_rounds(fitted: DataFrame, models: list[dict]) -> dict[int, tuple[int, float | None]]:
    """Per model the last tree to keep and its AUC: the best round where there is patience (the first of equal ones), else the last."""
    wanted = fitted.where(F.col("model").isin([m["id"] for m in models]))
    ends = wanted.groupBy("model").agg(F.max("tree").alias("last"), F.max(F.struct("area", (-F.col("tree")).alias("back"))).alias("top"),
                                       F.max(F.struct("tree", "area")).alias("end"))
    patient = {m["id"]: bool(m["patience"]) for m in models}
    out = {}
    for r in ends.collect():  # one row a model
        stops = patient[r["model"]] and r["top"]["area"] is not None
        out[r["model"]] = (-r["top"]["back"], r["top"]["area"]) if stops else (r["last"], r["end"]["area"])
    return out


def forests(fitted: DataFrame, lasts: dict[int, int | None]) -> dict[int, list[dict]]:
    """Some models' trees as arrays, in order, each up to its last one (None: all); bounded by the models' size."""
    out: dict[int, list[tuple[int, dict]]] = {i: [] for i in lasts}
    for r in fitted.where(F.col("model").isin(list(lasts))).collect():
        last = lasts[r["model"]]
        if last is None or r["tree"] <= last:
            out[r["model"]].append((r["tree"], {k: np.array(r[k]) for k in ("feature", "bin", "left", "right", "value", "cover")}))
    return {i: [tree for _, tree in sorted(found, key=lambda x: x[0])] for i, found in out.items()}


def binned(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Filled inputs (rows, features) as bins."""
    return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def margin_of(forest: list[dict], codes: np.ndarray) -> np.ndarray:
    return trees.Masks(forest).margin(codes)


def held_out_scores(p: Prepared, fitted: DataFrame, models: list[dict]) -> DataFrame:
    """(model, key, label, prob) of the rows of each model's held-out fold; key is the hash of the row's key."""
    by_id, fills, places, features = _plan(p, models)
    ends = best_rounds(fitted, models)
    kept = forests(fitted, {i: ends[i][0] for i in by_id})

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                m = by_id[row["model"]]
                v = View(Block(row, features), m, fills[m["fold"]], places)
                prob = trees.probability(margin_of(kept[m["id"]], v.codes[v.held]))
                yield pd.DataFrame({"model": m["id"], "key": v.keys[v.held], "label": v.label[v.held].astype(np.int32), "prob": prob})

    jobs = p.blocks.withColumn("model", F.explode(F.array(*[F.lit(i) for i in by_id])))
    return jobs.repartitionByRange(len(models) * p.n_blocks, "model", "block").mapInPandas(scored, "model int, key bigint, label int, prob double")


def random_draws(n: int = TRIALS, seed: int = RANDOM_STATE) -> list[dict]:
    """M2: seeded draws from the search ranges."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        draw = {}
        for name, (lo, hi, kind) in SEARCH_SPACE.items():
            if kind == "int":
                draw[name] = rng.randint(lo, hi)
            else:
                draw[name] = math.exp(rng.uniform(math.log(lo), math.log(hi))) if kind == "log" else rng.uniform(lo, hi)
        out.append(draw)
    return out


def search(p: Prepared, draws: list[dict] | None = None, patience: int | None = PATIENCE, seconds: float | None = None) -> list[dict]:
    """M2 + M3: each draw's AUC over the folds, every fold's trees stopping early; best first in ``best``.

    All folds of ``WAVE`` draws are trained together.  Every draw is tried, however long it
    takes; only a caller that sets ``seconds`` has no wave start after them.
    """
    draws, start, out = draws if draws is not None else random_draws(), time.monotonic(), []
    for at in range(0, len(draws), WAVE):
        if seconds is not None and out and time.monotonic() - start > seconds:
            break
        wave = [(at + i, d) for i, d in enumerate(draws[at : at + WAVE])]
        models = [Model(i * len(p.folds) + k, d, fold, patience) for i, d in wave for k, fold in enumerate(p.folds)]
        ends = best_rounds(fit(p, models), models)
        for i, d in wave:
            own = [ends[i * len(p.folds) + k] for k in range(len(p.folds))]
            areas = [a for _, a in own if a is not None]
            out.append({"trial": i, "params": d, "mean": float(np.mean(areas)) if areas else None, "std": float(np.std(areas)) if areas else None,
                        "trees": [t + 1 for t, _ in own]})
    top = max((r["mean"] for r in out if r["mean"] is not None), default=None)
    best = next((r["trial"] for r in out if r["mean"] == top), None)
    return [{**r, "best": r["trial"] == best} for r in out]


class BoostedModel:
    """A trained model with its preparation: derived features, fills, categories, cuts and trees."""

    def __init__(self, names: list[str], categorical: list[str], cuts: list[np.ndarray], fills: list[float], categories: dict[str, DataFrame],
                 forest: list[dict], params: dict):
        self.names, self.categorical, self.cuts, self.fills = names, categorical, cuts, fills
        self.categories, self.forest, self.params = categories, forest, params

    @property
    def n_trees(self) -> int:
        return len(self.forest) - 1

    def with_features(self, df: DataFrame) -> DataFrame:
        """Derived, filled and encoded inputs in the array ``features``; row-wise, so also on streams."""
        df = with_derived(df, refresh=True)
        inputs = []
        for name, fill in zip(self.names, self.fills, strict=True):
            if name not in self.categorical:
                inputs.append(F.coalesce(known(name), F.lit(fill)))
                continue
            table = bounded_broadcast(self.categories[name].select(F.col(name).alias("_category"), F.col("code").alias(f"_{name}_code")))
            value = known(name)
            df = df.join(table, value == F.col("_category"), "left").drop("_category")
            inputs.append(F.when(value.isNull(), F.lit(fill)).otherwise(F.coalesce(F.col(f"_{name}_code"), F.lit(-1.0))))
        return df.withColumn("features", F.array(*inputs)).drop(*[f"_{c}_code" for c in self.categorical])

    def transform(self, df: DataFrame) -> DataFrame:
        """M5: ``features`` and ``prob``, the probability of the positive class."""
        cuts, forest = self.cuts, self.forest

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            masks = trees.Masks(forest)  # once a task
            for x in batches:
                values = np.array(x.tolist(), float).reshape(len(x), len(cuts))
                yield pd.Series(trees.probability(masks.margin(binned(cuts, values))))

        return self.with_features(df).withColumn("prob", scored("features"))


def trained(p: Prepared, fitted: DataFrame, model: dict, last: int | None = None) -> BoostedModel:
    return BoostedModel(p.names, p.categorical, p.cuts, p.fills[model["fold"]], p.categories, forests(fitted, {model["id"]: last})[model["id"]], model["params"])


def save(spark: SparkSession, model: BoostedModel, path: str, metadata: dict) -> None:
    """Trees and categories as tables, the rest and the metadata as JSON."""
    rows = [_tree_row(0, t - 1, None, tree) for t, tree in enumerate(model.forest)]
    spark.createDataFrame(rows, TREES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    for c, table in model.categories.items():
        table.write.mode("overwrite").parquet(f"{path}/categories/{c}")
    state = {"names": model.names, "categorical": model.categorical, "cuts": [c.tolist() for c in model.cuts], "fills": model.fills, "params": model.params}
    for name, content in (("state", state), ("metadata-0", metadata)):
        spark.createDataFrame([(json.dumps(content),)], "content string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    return sorted(int(f.getPath().getName().split("-")[1]) for f in found if f.getPath().getName().startswith("metadata-"))


def merge_metadata(spark: SparkSession, path: str, extra: dict) -> dict:
    """Add to a saved model's metadata (threshold, metrics); the model itself stays as it is."""
    merged = {**load_metadata(spark, path), **extra}
    version = max(_versions(spark, path), default=-1) + 1
    spark.createDataFrame([(json.dumps(merged),)], "content string").coalesce(1).write.text(f"{path}/metadata-{version}")
    return merged


def load_metadata(spark: SparkSession, path: str) -> dict:
    """The newest metadata; empty if there are none."""
    versions = _versions(spark, path)
    return json.loads(spark.read.text(f"{path}/metadata-{versions[-1]}").first()[0]) if versions else {}


def load(spark: SparkSession, path: str) -> tuple[BoostedModel, dict]:
    """A missing model is an error, missing metadata are empty."""
    try:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        fitted = spark.read.schema(TREES).parquet(f"{path}/trees")
        forest = forests(fitted, {0: None})[0]
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"model not found: {path}") from e
    categories = {c: spark.read.parquet(f"{path}/categories/{c}") for c in state["categorical"]}
    model = BoostedModel(state["names"], state["categorical"], [np.array(c) for c in state["cuts"]], state["fills"], categories, forest, state["params"])
    return model, load_metadata(spark, path)


def serving_threshold(meta: dict) -> float:
    """M6: ``serving_threshold`` wins over ``threshold``; default 0.5."""
    return float(meta.get("serving_threshold", meta.get("threshold", DEFAULT_THRESHOLD)))
