"""Kernels of the leaf-wise booster, over one block of binned rows (NumPy).

Gradients and hessians are integers (multiples of 1 / ``SCALE``), so sums over rows don't
depend on their order or on how the rows are dealt over blocks: a model is the same
from one block as from many.  A node's best split is found from its histogram, per
sampled feature and bin the sums of gradients, hessians and rows; of two children only the
smaller one is counted, the other is the parent less it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np

SCALE = float(1 << 24)
BINS = 64
MISSING = 255
AUC_BUCKETS = 8192
LEAST_HESSIAN = 1e-3 * SCALE
MANY_ROWS = 4096  # rows from which pairs of features are counted
CACHED_ROWS = 1 << 14  # rows whose intermediate arrays stay in a core's cache

Split = tuple[float, int, int, np.ndarray, np.ndarray]  # gain, feature, bin, sums on the left and on the right


def sampled(params: dict, tree: int, features: int) -> np.ndarray:
    """The features that a tree may split on."""
    n = max(1, int(round(features * params["colsample_bytree"])))
    return np.sort(np.random.default_rng([params["random_state"], tree]).permutation(features)[:n])


def in_bag(params: dict, tree: int, keys: np.ndarray) -> np.ndarray | None:
    """The rows that a tree is grown on, by a hash of their keys; None if it is all of them."""
    every = params["subsample_freq"]
    if not every or params["subsample"] >= 1:
        return None
    x = keys.astype(np.uint64) + np.uint64((tree // every + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(params["subsample"] * float(1 << 63)) * 2)


def probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def gradients(margin: np.ndarray, label: np.ndarray, params: dict) -> tuple[np.ndarray, np.ndarray]:
    no, yes = params["class_weight"]
    g, h = np.empty(len(margin)), np.empty(len(margin))
    for a in range(0, len(margin), CACHED_ROWS):
        part = slice(a, a + CACHED_ROWS)
        p, y = probability(margin[part]), label[part]
        weight = SCALE * (np.where(y > 0, yes, no) if no != yes else yes)
        np.rint((p - y) * weight, out=g[part])
        np.rint(p * (1.0 - p) * weight, out=h[part])
    return g, h


def start_margin(positive: int, rows: int, params: dict) -> float:
    no, yes = params["class_weight"]
    total = positive * yes + (rows - positive) * no
    share = min(max(positive * yes / total if total else 0.5, 1e-15), 1 - 1e-15)
    return math.log(share / (1 - share))


def _worth(g: np.ndarray, h: np.ndarray, params: dict) -> np.ndarray:
    """What sums of gradients and hessians are worth, times SCALE."""
    t = np.maximum(np.abs(g) - params["reg_alpha"] * SCALE, 0.0)
    return t * t / (h + params["reg_lambda"] * SCALE)


def leaf_value(sums: np.ndarray, params: dict) -> float:
    g, h = sums[0] / SCALE, sums[1] / SCALE
    return float(-np.sign(g) * max(abs(g) - params["reg_alpha"], 0.0) / (h + params["reg_lambda"]) * params["learning_rate"])


def best_splits(hists: np.ndarray, used: np.ndarray, params: dict) -> list[Split | None]:
    """The best split of each node; hists: (nodes, 3, used features, bins).  Of equal gains the first feature, then the least bin."""
    total = hists[:, :, 0].sum(axis=2)
    left = hists.cumsum(axis=3)[..., :-1]
    right = total[:, :, None, None] - left
    fewer, lighter = np.minimum(left[:, 2], right[:, 2]), np.minimum(left[:, 1], right[:, 1])
    fits = (fewer >= params["min_child_samples"]) & (lighter >= LEAST_HESSIAN)
    gain = np.where(fits, _worth(left[:, 0], left[:, 1], params) + _worth(right[:, 0], right[:, 1], params), -np.inf)
    best = gain.reshape(len(hists), -1).argmax(axis=1)
    whole = _worth(total[:, 0], total[:, 1], params)
    out: list[Split | None] = []
    for i, at in enumerate(best):
        f, b = divmod(int(at), gain.shape[2])
        won = float(gain[i, f, b] - whole[i]) / SCALE
        out.append((won, int(used[f]), b, left[i, :, f, b].copy(), right[i, :, f, b].copy()) if won > 0 else None)
    return out


class Tree:
    """Nodes in the order of their making; feature -1 marks a leaf."""

    def __init__(self, sums: np.ndarray):
        self.feature, self.bin, self.left, self.right, self.sums = [-1], [0], [-1], [-1], [sums]

    def split(self, node: int, found: Split) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = found[1], found[2], a, a + 1
        for sums in found[3:]:
            self.feature.append(-1), self.bin.append(0), self.left.append(-1), self.right.append(-1), self.sums.append(sums)
        return a, a + 1

    def arrays(self, params: dict) -> dict[str, np.ndarray]:
        return {
            "feature": np.array(self.feature, np.int32), "bin": np.array(self.bin, np.int32), "left": np.array(self.left, np.int32),
            "right": np.array(self.right, np.int32), "value": np.array([leaf_value(s, params) for s in self.sums]),
            "cover": np.array([int(s[2]) for s in self.sums], np.int64),
        }


def routed(tree: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The leaf of each row; codes: (rows, features)."""
    node = np.zeros(len(codes), np.int64)
    rows = np.arange(len(codes))
    if tree["feature"][0] < 0:
        return node
    while len(rows):
        at = node[rows]
        goes_left = codes[rows, tree["feature"][at]] <= tree["bin"][at]
        at = np.where(goes_left, tree["left"][at], tree["right"][at])
        node[rows] = at
        rows = rows[tree["feature"][at] >= 0]
    return node


class Masks:
    """Trees as tables: per feature and code the leaves that it doesn't rule out, as bits; a row's leaf is the one bit that all its codes leave.

    A tree of over 64 leaves is routed node by node.
    """

    ROWS = 8192  # whose bits and codes stay in a core's cache
    PLACE = np.uint64(0x03F79D71B4CB0A89)  # a de Bruijn number: a bit times it has another top six bits for each bit

    def __init__(self, forest: list[dict[str, np.ndarray]]):
        self.forest, self.tables = forest, [self._tables(tree) for tree in forest]

    @classmethod
    def _place(cls, bits: np.ndarray) -> np.ndarray:
        return ((bits * cls.PLACE) >> np.uint64(58)).astype(np.intp)

    @classmethod
    def _tables(cls, tree: dict[str, np.ndarray]) -> tuple[dict[int, np.ndarray], np.ndarray] | None:
        feature, ends = tree["feature"], np.flatnonzero(tree["feature"] < 0)
        if len(ends) > 64:
            return None
        below = np.zeros(len(feature), np.uint64)
        below[ends] = np.uint64(1) << np.arange(len(ends), dtype=np.uint64)
        inner = np.flatnonzero(feature >= 0)
        for n in inner[::-1]:  # children come after their parent
            below[n] = below[tree["left"][n]] | below[tree["right"][n]]
        tables = {int(f): np.full(256, ~np.uint64(0)) for f in feature[inner]}
        for n in inner:
            table, cut = tables[int(feature[n])], int(tree["bin"][n]) + 1
            table[:cut] &= ~below[tree["right"][n]]
            table[cut:] &= ~below[tree["left"][n]]
        if tables:  # bits without a leaf
            tables[int(feature[0])] &= below[0]
        values = np.zeros(64)
        values[cls._place(below[ends])] = tree["value"][ends]
        return tables, values

    def margin(self, codes: np.ndarray) -> np.ndarray:
        """The sum of the trees' values for each row, tree after tree; codes: (rows, features)."""
        return self.margin_of(codes.T)

    def margin_of(self, codes: np.ndarray) -> np.ndarray:
        """The same of codes by (features, rows)."""
        out = np.zeros(codes.shape[1])
        for a in range(0, len(out), self.ROWS):
            part, own = codes[:, a : a + self.ROWS], out[a : a + self.ROWS]
            columns = part.astype(np.intp, order="C")
            bits, more = np.empty(len(own), np.uint64), np.empty(len(own), np.uint64)
            for tree, made in zip(self.forest, self.tables, strict=True):
                if made is None or not made[0]:
                    own += tree["value"][routed(tree, part.T)]
                    continue
                tables, values = made
                for i, (f, table) in enumerate(tables.items()):
                    table.take(columns[f], out=more if i else bits, mode="clip")
                    if i:
                        np.bitwise_and(bits, more, out=bits)
                own += values.take(self._place(bits))
        return out


Region = dict[int, tuple[int, int]]  # feature -> codes (low, high] that lead to a node


def inside(regions: list[Region], codes: np.ndarray) -> np.ndarray:
    """For each row the region that it lies in, or -1; the regions are disjoint, codes: (features, rows)."""
    out = np.full(codes.shape[1], -1, np.int32)
    for first in range(0, len(regions), 64):
        some = regions[first : first + 64]
        tables = {}
        for f in sorted({f for region in some for f in region}):
            tables[f] = np.zeros(256, np.uint64)
            for k, region in enumerate(some):
                low, high = region.get(f, (-1, 255))
                tables[f][low + 1 : high + 1] |= np.uint64(1) << np.uint64(k)
        for a in range(0, len(out), 4 * Masks.ROWS):
            part = slice(a, a + 4 * Masks.ROWS)
            bits = None
            for f, table in tables.items():
                here = table[codes[f, part]]
                bits = here if bits is None else np.bitwise_and(bits, here, out=bits)
            if bits is None:  # the root
                out[part] = first
                continue
            at = np.flatnonzero(bits)
            out[part][at] = first + _BIT[((bits[at] * Masks.PLACE) >> np.uint64(58)).astype(np.intp)]
    return out


_BIT = np.zeros(64, np.int32)
_BIT[Masks._place(np.uint64(1) << np.arange(64, dtype=np.uint64))] = np.arange(64)


class Columns:
    """Codes of the sampled features, a row a feature.

    Of many rows two features are counted at once, as cells of a 64 x 64 table whose margins
    are their histograms; sums are integers, hence exact either way.
    """

    def __init__(self, codes: np.ndarray):
        self.codes, self.pairs, self.cells = codes, [], None
        if codes.shape[1] < 16 * MANY_ROWS:  # small enough to keep the cells of each row
            self.cells = codes.T.astype(np.int64, order="C") + np.arange(len(codes)) * BINS
        if codes.shape[1] >= MANY_ROWS:
            self.pairs = [codes[i].astype(np.int16) * BINS + codes[i + 1] for i in range(0, len(codes) - 1, 2)]

    def histogram(self, rows: np.ndarray | None, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(3, features, bins) of some rows (None: all)."""
        return self.summed(rows, Sums(g, h))

    def summed(self, rows: np.ndarray | None, sums: Sums) -> np.ndarray:
        width, n = len(self.codes), self.codes.shape[1] if rows is None else len(rows)
        if n < MANY_ROWS:
            weights = sums.of(slice(n) if rows is None else rows)
            if self.cells is not None:
                cells, spread = (self.cells if rows is None else self.cells.take(rows, axis=0, mode="clip")).ravel(), np.repeat
            else:
                cells, spread = (self.codes[:, rows].astype(np.int64) + (np.arange(width) * BINS)[:, None]).ravel(), np.tile
            return sums.parted(np.stack([np.bincount(cells, spread(w, width), width * BINS).reshape(width, BINS) for w in weights]))
        out, found = np.zeros((3, width, BINS)), np.empty((len(sums.weights), width, BINS))
        for a in range(0, n, sums.rows):
            part = slice(a, a + sums.rows) if rows is None else rows[a : a + sums.rows]
            weights = sums.of(part)
            for i, pair in enumerate(self.pairs):
                cells = (pair[part] if rows is None else pair.take(part, mode="clip")).astype(np.int64)
                for k, w in enumerate(weights):
                    both = np.bincount(cells, w, BINS * BINS).reshape(BINS, BINS)
                    found[k, 2 * i], found[k, 2 * i + 1] = both.sum(axis=1), both.sum(axis=0)
            if width % 2:
                cells = self.codes[-1][part].astype(np.int64)
                for k, w in enumerate(weights):
                    found[k, -1] = np.bincount(cells, w, BINS)
            out += sums.parted(found)
        return out


class Sums:
    """What a tree's histograms sum up.  A row counts as a high bit of its hessian, so that one sum of
    ``rows`` rows, which a double holds exactly, gives hessians and rows; large hessians, of heavy classes, are summed apart."""

    def __init__(self, g: np.ndarray, h: np.ndarray):
        bits = int(h.max(initial=1)).bit_length()
        self.rows = 1 << max(0, (53 - bits) // 2)
        self.bit = float(self.rows << bits)
        self.weights = [g, h + self.bit]
        if self.rows < MANY_ROWS:
            self.rows, self.bit, self.weights = 1 << 15, 0.0, [g, h, np.ones(len(g))]

    def of(self, part: np.ndarray | slice) -> list[np.ndarray]:
        return [w[part] if isinstance(part, slice) else w.take(part, mode="clip") for w in self.weights]

    def parted(self, found: np.ndarray) -> np.ndarray:
        """Sums of gradients, hessians and rows."""
        if not self.bit:
            return found
        n = np.floor(found[1] / self.bit)
        return np.stack([found[0], found[1] - n * self.bit, n])


def node_histograms(codes: np.ndarray, at: np.ndarray, nodes: list[int], used: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(nodes, 3, used features, bins) as integers; codes: (rows, features), at: the node of each row."""
    place = np.full(max(int(at.max(initial=0)), *nodes) + 1, -1)
    place[nodes] = np.arange(len(nodes))
    base = place[at]
    own = np.flatnonzero(base >= 0)
    return histograms([codes[:, f].take(own) for f in used], base[own], len(nodes), g[own], h[own])


def histograms(columns: list[np.ndarray], base: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(nodes, 3, features, bins) as integers; base: the node of each row, from 0.  Of many rows two features are counted at once (:class:`Columns`)."""
    out = np.empty((3, len(columns), nodes, BINS), np.int64)
    in_pairs = len(base) >= MANY_ROWS // 4 * nodes
    wide = base.astype(np.int64) * (BINS * BINS)
    narrow = base.astype(np.int64) * BINS
    for i in range(0, len(columns), 2):
        if in_pairs and i + 1 < len(columns):
            cell = columns[i].astype(np.int64) * BINS
            cell += columns[i + 1]
            cell += wide
            for k, weights in enumerate((g, h, None)):
                both = np.bincount(cell, weights, nodes * BINS * BINS).reshape(nodes, BINS, BINS)
                out[k, i], out[k, i + 1] = both.sum(axis=2), both.sum(axis=1)
            continue
        for j, column in enumerate(columns[i : i + 2], i):
            cell = narrow + column
            for k, weights in enumerate((g, h, None)):
                out[k, j] = np.bincount(cell, weights, nodes * BINS).reshape(-1, BINS)
    return out.transpose(2, 0, 1, 3)


def grown(codes: np.ndarray, g: np.ndarray, h: np.ndarray, used: np.ndarray, params: dict) -> tuple[Tree, dict[int, np.ndarray]]:
    """One tree, the leaf of the largest gain first (of equal ones the oldest), and the rows of each leaf; codes: (used features, rows)."""
    columns, sums = Columns(codes), Sums(g, h)
    rows_of = {0: np.arange(codes.shape[1])}
    hist = columns.summed(None, sums)
    tree = Tree(hist[:, 0].sum(axis=1))
    queue: list = []

    def offered(nodes: list[int], hists: np.ndarray) -> None:
        for node, hist, found in zip(nodes, hists, best_splits(hists, used, params), strict=True):
            if found:
                heapq.heappush(queue, (-found[0], node, found, hist))

    offered([0], hist[None])
    column = {int(f): i for i, f in enumerate(used)}
    leaves = 1
    while queue and leaves < params["num_leaves"]:
        _, node, found, hist = heapq.heappop(queue)
        children = tree.split(node, found)
        leaves += 1
        f, rows = column[found[1]], rows_of.pop(node)
        goes_left = codes[f].take(rows, mode="clip") <= found[2]
        sides = rows.take(np.flatnonzero(goes_left), mode="clip"), rows.take(np.flatnonzero(~goes_left), mode="clip")  # twice as fast as by the mask itself
        rows_of.update(zip(children, sides, strict=True))
        if leaves == params["num_leaves"]:
            break
        small = 0 if len(sides[0]) <= len(sides[1]) else 1
        part = columns.summed(sides[small], sums)
        hists = np.stack((part, hist - part) if small == 0 else (hist - part, part))
        offered(list(children), hists)
    return tree, rows_of


def auc_counts(margin: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(2, buckets): rows of either class by probability."""
    at = np.minimum((probability(margin) * AUC_BUCKETS).astype(np.int64), AUC_BUCKETS - 1)
    return np.bincount(at + label.astype(np.int64) * AUC_BUCKETS, minlength=2 * AUC_BUCKETS).reshape(2, AUC_BUCKETS)


def auc_of(counts: np.ndarray) -> float | None:
    """The area under the curve; rows of one bucket are ties."""
    no, yes = (int(x) for x in counts.sum(axis=1))
    if not no or not yes:
        return None
    below = np.concatenate([[0], np.cumsum(counts[0])[:-1]])
    return float((counts[1] * (below + counts[0] / 2.0)).sum() / (float(no) * yes))


class Patience:
    """Stops after some rounds without a better area; the best round is the one to keep."""

    def __init__(self, rounds: int | None):
        self.rounds, self.best, self.round = rounds, -1.0, None

    def ends(self, tree: int, area: float | None) -> bool:
        if not self.rounds or area is None:
            return False
        if area > self.best:
            self.best, self.round = area, tree
        return tree - self.round >= self.rounds


def filled(codes: np.ndarray, seen: np.ndarray, fold: int, fills: list[int], categorical: list[int]) -> np.ndarray:
    """The codes as a model sees them, by (rows, features): what is missing filled, categories that only its held-out fold has in bin 0.

    codes: (features, rows); seen: per categorical feature and row a bit for each fold that has the category.
    """
    return np.ascontiguousarray(filled_columns(codes, seen, fold, fills, categorical).T)


def filled_columns(codes: np.ndarray, seen: np.ndarray, fold: int, fills: list[int], categorical: list[int]) -> np.ndarray:
    """The same by (features, rows)."""
    out = codes.copy()
    for f, fill in enumerate(fills):
        out[f][np.flatnonzero(codes[f] == MISSING)] = fill
    if fold >= 0:
        for i, f in enumerate(categorical):
            only_here = (codes[f] != MISSING) & ((seen[i] & ~np.int64(1 << fold)) == 0)
            out[f][only_here] = 0
    return out


def boosted(codes: np.ndarray, label: np.ndarray, held: np.ndarray, keys: np.ndarray, params: dict, patience: int | None) -> Iterator[tuple[float | None, dict]]:
    """A whole model over one block: (area on the held-out rows, tree) round by round; the first is the start."""
    x, y = codes[~held], label[~held].astype(float)
    other, other_y, own_keys = codes[held], label[held], keys[~held]
    start = start_margin(int(y.sum()), len(y), params)
    margin, other_margin = np.full(len(y), start), np.full(len(other), start)
    more = np.empty(len(y))
    yield None, {"feature": np.array([-1]), "bin": np.array([0]), "left": np.array([-1]), "right": np.array([-1]), "value": np.array([start]), "cover": np.array([len(y)])}
    stop = Patience(patience)
    columns = np.ascontiguousarray(x.T)
    for t in range(params["n_estimators"]):
        used = sampled(params, t, codes.shape[1])
        own = columns[used]
        g, h = gradients(margin, y, params)
        bag = in_bag(params, t, own_keys)
        if bag is None:
            tree, rows_of = grown(own, g, h, used, params)
            tree = tree.arrays(params)
            for leaf, rows in rows_of.items():
                more[rows] = tree["value"][leaf]
            margin += more
        else:
            tree = grown(np.ascontiguousarray(own[:, bag]), g[bag], h[bag], used, params)[0].arrays(params)
            margin += tree["value"][routed(tree, x)]
        other_margin += Masks([tree]).margin(other) if len(other) >= MANY_ROWS else tree["value"][routed(tree, other)]
        area = auc_of(auc_counts(other_margin, other_y)) if len(other) else None
        yield area, tree
        if stop.ends(t, area):
            return
