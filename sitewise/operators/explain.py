"""Per-row explanations (M14, M21): path-dependent tree SHAP over a boosted model.

A leaf's path is merged first: per feature on it one interval of bins and one cover
ratio z, the share of rows that would go on to the leaf if the feature were unknown.  With
o = 1 where a row's bin lies in the interval and else 0, the Shapley value of feature i for
the leaf's value v is

    v (o_i - z_i) * integral over t in [0, 1] of the product over j != i of (z_j (1 - t) + o_j t)

since the integral of t^k (1 - t)^(d-1-k) is the Shapley weight of a subset of k of the other
d - 1 features (Lundberg, Erion and Lee, 2018, define the values).  The integrand is a
polynomial of degree d - 1, so Gauss-Legendre points give it exactly.  It depends on the
row through the bits o alone: a leaf's values are computed once per bit pattern.  Neighbouring
leaves share most of their paths, so their values are summed for each pattern of the bits of all of
them, and a row only looks up its pattern of each such group, made by adding a small table per feature.

Values are log-odds: base + sum of values = log-odds of the probability.  The ranking by
absolute value runs JVM-side (``array_sort`` and ``slice``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from .booster import BoostedModel, binned
from .trees import BINS


class Leaf:
    """The merged path to a leaf: features, their intervals of bins (low, high] and their cover ratios."""

    def __init__(self, value: float):
        self.value, self.low, self.high, self.ratio = value, {}, {}, {}


def leaves(tree: dict[str, np.ndarray]) -> list[Leaf]:
    """All leaves of a tree."""
    out = []
    todo = [(0, {})]  # node, feature -> (low, high, ratio)
    while todo:
        node, path = todo.pop()
        f = int(tree["feature"][node])
        if f < 0:
            leaf = Leaf(float(tree["value"][node]))
            for g, (low, high, ratio) in path.items():
                leaf.low[g], leaf.high[g], leaf.ratio[g] = low, high, ratio
            out.append(leaf)
            continue
        low, high, ratio = path.get(f, (-1, BINS, 1.0))
        cut, cover = int(tree["bin"][node]), tree["cover"]
        for child, interval in ((int(tree["left"][node]), (low, min(high, cut))), (int(tree["right"][node]), (max(low, cut), high))):
            todo.append((child, {**path, f: (*interval, ratio * cover[child] / cover[node])}))
    return out


_POINTS: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # a table, since a cached function doesn't travel to tasks by value


def _points(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POINTS:
        points, weights = np.polynomial.legendre.leggauss(n)
        _POINTS[n] = (points + 1) / 2, weights / 2
    return _POINTS[n]


def _shares(ratio: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(patterns, features): the Shapley share of each feature of a leaf for each bit pattern."""
    d = len(ratio)
    t, w = _points((d + 1) // 2)
    factor = ratio[None, :, None] * (1 - t) + bits[:, :, None] * t
    return (bits - ratio) * ((factor.prod(axis=1)[:, None, :] / factor) @ w)


#: bits of a row's pattern within a group of leaves, and rows whose values stay in a core's cache
GROUP_BITS, CACHED_ROWS = 10, 2048
#: rows for which the groups' values are computed once
ROWS_AT_ONCE = 1 << 16

Condition = tuple[int, int, int]  # feature, low, high


def grouped(tree: dict[str, np.ndarray]) -> list[tuple[list[Condition], list[Leaf]]]:
    """Neighbouring leaves with their conditions together, as many as ``GROUP_BITS`` bits tell apart; a leaf of more conditions is a group."""
    out: list[tuple[list[Condition], list[Leaf]]] = []
    for leaf in leaves(tree):
        if not leaf.ratio:
            continue
        own = [(f, leaf.low[f], leaf.high[f]) for f in leaf.ratio]
        if out:
            known, group = out[-1]
            new = [c for c in own if c not in known]
            if len(known) + len(new) <= GROUP_BITS:
                known += new
                group.append(leaf)
                continue
        out.append((own, [leaf]))
    return out


def shap_values(forest: list[dict], codes: np.ndarray, features: int) -> np.ndarray:
    """SHAP values (rows, features) of binned rows, in log-odds."""
    phi = np.zeros((len(codes), features))
    columns = np.ascontiguousarray(codes.T).astype(np.intp)
    for tree in forest:
        groups = grouped(tree)
        if not groups:
            continue
        pattern = np.zeros((len(groups), len(codes)), np.int64)
        for k, (conditions, _) in enumerate(groups):
            tables: dict[int, np.ndarray] = {}
            for bit, (f, low, high) in enumerate(conditions):
                tables.setdefault(f, np.zeros(BINS, np.int64))[low + 1 : high + 1] |= 1 << bit
            for f, table in tables.items():
                pattern[k] += table.take(columns[f])
        wholes = []
        for k, (conditions, group) in enumerate(groups):
            if 1 << len(conditions) <= max(4 * len(codes), 1 << GROUP_BITS):
                kinds = np.arange(1 << len(conditions))
            else:
                kinds, pattern[k] = np.unique(pattern[k], return_inverse=True)
            whole = np.zeros((len(kinds), features))  # a row of all features is added faster than some of its columns
            for leaf in group:
                names, ratio = list(leaf.ratio), np.array(list(leaf.ratio.values()))
                bits = [conditions.index((f, leaf.low[f], leaf.high[f])) for f in names]
                if len(bits) < len(conditions):  # each pattern of the leaf's own bits once
                    own = np.arange(1 << len(bits))
                    at = sum(((kinds >> b & 1) << i for i, b in enumerate(bits)), np.zeros(len(kinds), np.int64))
                    if len(own) > len(kinds):
                        own, at = np.unique(at, return_inverse=True)
                    whole[:, names] += (leaf.value * _shares(ratio, (own[:, None] >> np.arange(len(bits)) & 1).astype(float))).take(at, axis=0)
                else:
                    whole[:, names] += leaf.value * _shares(ratio, (kinds[:, None] >> np.array(bits) & 1).astype(float))
            wholes.append(whole)
        found = np.empty((min(CACHED_ROWS, len(codes)), features))
        for a in range(0, len(codes), CACHED_ROWS):
            part = phi[a : a + CACHED_ROWS]
            for whole, at in zip(wholes, pattern, strict=True):
                part += whole.take(at[a : a + CACHED_ROWS], axis=0, out=found[: len(part)], mode="clip")
    return phi


def expected(forest: list[dict]) -> float:
    """The mean margin of the training rows' leaves by cover: what an explanation starts from."""
    total = 0.0
    for tree in forest:
        ends = tree["feature"] < 0
        total += float((tree["value"][ends] * tree["cover"][ends]).sum() / tree["cover"][0])
    return total


def explain(scored: DataFrame, model: BoostedModel, keep: list[str], top_n: int = 5) -> DataFrame:
    """``top_features`` = the ``top_n`` largest |SHAP| with value (4 digits) and direction, besides ``shap`` and ``base``.

    scored: rows with the array ``features`` of :meth:`BoostedModel.transform`.
    """
    names, cuts, forest = model.names, model.cuts, model.forest
    src = scored.select(*keep, F.col("features").alias("_x"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep] + ["shap array<double>", "base double"])
    base = expected(forest)

    def valued(held: list[tuple[pd.DataFrame, np.ndarray]]) -> Iterator[pd.DataFrame]:
        codes = np.concatenate([c for _, c in held])
        phi, at = shap_values(forest, codes, len(names)), 0
        for out, c in held:
            out["shap"] = list(phi[at : at + len(c)])
            out["base"] = base
            at += len(c)
            yield out

    def explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for rows in batches:
            x = np.array(rows["_x"].tolist(), float).reshape(len(rows), len(names))
            held.append((rows[keep].copy(), binned(cuts, x)))
            n += len(rows)
            if n >= ROWS_AT_ONCE:
                yield from valued(held)
                held, n = [], 0
        if held:
            yield from valued(held)

    values = src.mapInPandas(explained, schema)
    items = F.transform(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("f"), F.col("shap").alias("v")), lambda e: F.struct(
        e["f"].alias("feature"), F.round(e["v"], 4).alias("shap_value"), fx.direction(e["v"]).alias("direction"), F.abs(e["v"]).alias("_a")))
    ranked = F.array_sort(items, lambda a, b: F.when(a["_a"] > b["_a"], -1).when(a["_a"] < b["_a"], 1).otherwise(0))
    top = F.transform(F.slice(ranked, 1, top_n), lambda e: F.struct(e["feature"], e["shap_value"], e["direction"]))
    return values.withColumn("top_features", top)


def scored_records(scored: DataFrame, model: BoostedModel, keep: list[str], with_explanation: bool, top_n: int = 5) -> DataFrame:
    """The records as they are or, on request, with ``top_features``."""
    return explain(scored, model, keep, top_n).drop("shap", "base") if with_explanation else scored.select(*keep)
