"""Nearest neighbours by inner product, over randomly rotated one-bit codes.

Every vector is centred, rotated by a random orthogonal matrix and kept as the signs
of its components, packed into bits, with two correction scalars: its distance from
the centre and how far its code points in its own direction.  From the bits alone the
inner product with a query is estimated without bias, with an error bound that holds
with high probability.  Per query, the likeliest vectors by the estimate are scored
exactly, and all vectors whose upper bound reaches the k-th best of these scores are
checked: by a single precision product of whole blocks, then, where that reaches it too, by
the exact inner product in double precision.

Queries and vectors meet in blocks: each task holds one block of codes and one block of
queries, and hands on k rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20
CENTRE_ROWS = 10_000    # bound on the rows, chosen by a hash of vec_id, that the centre is fitted on
VECTOR_BLOCK = 8_192    # vectors of a block on average
QUERY_BLOCK = 1_024     # queries of a block on average
QUERIES_AT_ONCE = 64
LIKELY = 8              # times k: groups of a block's vectors whose likeliest one is scored first
ERROR = 4.0             # half width of the bounds, in standard errors of the estimate


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and every component finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dimension: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of some vectors around a centre."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> None:
        self.dimension = vectors.shape[1]
        around = vectors - centre
        self.norm = np.linalg.norm(around, axis=1)
        unit = around / np.where(self.norm > 0, self.norm, 1)[:, None]
        turned = unit @ turn
        self.bits = np.packbits(turned > 0, axis=1)
        #: inner product of the unit vector with its code
        self.own = np.abs(turned).sum(axis=1) / np.sqrt(self.dimension)
        self.own[self.norm == 0] = 1.0
        #: the vectors that the codes stand for: code = (2 bits - 1) / sqrt(d), as far out as makes the estimate unbiased
        self.points = np.unpackbits(self.bits, axis=1, count=self.dimension).astype(np.float32) * 2 - 1
        self.points *= (self.norm / self.own / np.sqrt(self.dimension)).astype(np.float32)[:, None]
        self.spread = (ERROR * self.norm * np.sqrt(np.maximum(0, 1 - self.own**2)) / self.own / np.sqrt(max(1, self.dimension - 1))).astype(np.float32)

    def bounds(self, queries: np.ndarray, turn: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (query, vector), and half widths of their bounds, in single precision.

        <q, v> = <q, centre> + |v - centre| <q, u>, with <q, u> estimated as
        <q, code> / <u, code>; its error shrinks as the code comes closer to u.
        """
        middle = (queries @ turn).astype(np.float32) @ self.points.T
        middle += (queries @ centre).astype(np.float32)[:, None]
        return middle, np.multiply.outer(np.linalg.norm(queries, axis=1).astype(np.float32), self.spread)


def _blocks(batch: pa.Table, column: str) -> np.ndarray:
    values = batch.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _likely(estimates: np.ndarray, k: int) -> np.ndarray:
    """Per query places of at least k of the largest estimates, or of all if there are fewer: the largest one of each of many groups."""
    n = estimates.shape[1]
    groups = LIKELY * k
    if n < 2 * groups:
        return np.broadcast_to(np.arange(n), estimates.shape)
    width = n // groups
    best = estimates[:, : groups * width].reshape(len(estimates), groups, width).argmax(axis=2)
    return best + np.arange(groups) * width


def _search(k: int, centre: np.ndarray, turn: np.ndarray):  # noqa: ANN202
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and queries.num_rows:
            data, ids = _blocks(vectors, "embedding"), vectors.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            data, ids = data[order], ids[order]
            asked, names = _blocks(queries, "embedding"), queries.column("query_id").to_numpy()
            # lengths of 1 at most, so that single precision holds them; the scores themselves are those of the vectors as given
            size = max(float(np.abs(data).max()) * np.sqrt(data.shape[1]), np.finfo(float).tiny)
            lengths = np.linalg.norm(asked, axis=1)
            lengths[lengths == 0] = 1.0
            codes, small = Codes(data / size, centre / size, turn), (data / size).astype(np.float32)
            slack = np.float32(4 * (data.shape[1] + 2) * np.finfo(np.float32).eps)
            for i in range(0, len(asked), QUERIES_AT_ONCE):
                q, who, length = asked[i : i + QUERIES_AT_ONCE], names[i : i + QUERIES_AT_ONCE], lengths[i : i + QUERIES_AT_ONCE]
                unit = q / length[:, None]
                upper, half = codes.bounds(unit, turn, centre / size)
                own = list(zip(np.searchsorted(ids, who), np.searchsorted(ids, who, "right"), strict=True))
                for j, (a, b) in enumerate(own):
                    upper[j, a:b] = -np.inf
                likely = _likely(upper, k)
                least = np.full(len(q), -np.inf)
                if likely.shape[1] >= k:
                    first = np.einsum("jcd,jd->jc", data[likely], q) / (length * size)[:, None]
                    first[ids[likely] == who[:, None]] = -np.inf
                    least = np.partition(first, likely.shape[1] - k, axis=1)[:, likely.shape[1] - k]
                floor = (least - slack).astype(np.float32)[:, None]
                upper += half
                reach = upper >= floor
                some = np.flatnonzero(reach.any(axis=0))
                reach = reach[:, some] & (unit.astype(np.float32) @ small[some].T >= floor)
                for j in range(len(q)):
                    near = some[reach[j]]
                    near = near[ids[near] != who[j]]
                    score = (data[near] * q[j]).sum(axis=1)  # one expression for any number of rows: equal vectors have equal scores
                    best = np.lexsort((ids[near], -score))[:k]
                    found.append((np.full(len(best), who[j]), ids[near][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first.

    vectors: (vec_id long, embedding array of numbers of one length).  is_query picks the
    queries; candidates are all rows of another vec_id.  Rows without a vec_id and vectors
    null, empty, zero or with a null or non-finite component take no part.  Ties go to the
    smaller vec_id; repeated rows are candidates once each.  An empty table gives no rows.
    """
    whole = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    whole = whole.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sample = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_ROWS)
    means = sample.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()  # one row a dimension
    centre = np.array([r["x"] for r in means])
    turn = rotation(len(centre))
    total, asked = whole.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    n_vectors, n_queries = max(1, -(-total // VECTOR_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    block = F.xxhash64("vec_id")
    left = whole.select("vec_id", "embedding", F.pmod(block, F.lit(n_vectors)).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"))
    right = whole.filter(is_query).select(
        F.col("vec_id").alias("query_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(n_vectors - 1))).alias("v"), F.pmod(block, F.lit(n_queries)).alias("q"))
    right = right.select("query_id", "embedding", F.col("v").cast("long").alias("v"), "q")
    left = left.select("vec_id", "embedding", "v", F.col("q").cast("long").alias("q"))
    found = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(_search(k, centre, turn), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
