"""Ranking and recommendation.

Top-N is a total order plus ``limit``, which Spark plans as
``TakeOrderedAndProject``: every partition keeps its own N best and only
N·partitions rows reach the final merge.  Ties on the rounded score keep
input order through an explicit sequence column (trap 21).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranking


def top_n(df: DataFrame, n: int, score: str = "suitability_score", seq: str = "candidate_id") -> DataFrame:
    """K1: rank by score desc (nulls last), ties by ``seq``, keep the first ``n``."""
    if not 1 <= n <= 500:
        raise ValueError("top_n must be within 1..500")
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(seq).asc()).limit(n)


def top_n_per_group(df: DataFrame, n: int, group: str, score: str = "suitability_score",
                    seq: str = "candidate_id") -> DataFrame:
    """M20 for many request sets at once: the first ``n`` per ``group``.

    The window is partitioned by the request id, so each set is ranked in
    its own task; Spark's window group limit pushes ``rank <= n`` below the
    shuffle (partial top-N per map partition).
    """
    w = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(seq).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def batch_ids(df: DataFrame, id_col: str = "candidate_id", order: str = "seq") -> DataFrame:
    """``zone_id`` is the record's id, else its position from 0 in ``order`` (if there)."""
    given = F.col(id_col).cast("string")
    if order == id_col or order not in df.columns:
        return df.withColumn("zone_id", given)
    numbered = ranking.row_numbers(df, [order], "_position")
    return numbered.withColumn("zone_id", F.coalesce(given, (F.col("_position") - 1).cast("string"))).drop("_position")
