"""Exact quantiles by selection: counts travel, values don't.

Every wanted rank (column, population, position) starts with the column's least and
largest value as bounds.  A pass over the rows counts, for all ranks at once, how many values
lie in each of ``PARTS`` equal stretches between a rank's bounds, with the least and the
largest value of each stretch; the stretch that holds the rank gives the next bounds.  A rank
is found when its bounds are one value or it is the first or last of its stretch.  What is
shuffled and collected is some hundred numbers a rank, whatever the number of rows or of
distinct values; a pass divides the bounds by ``PARTS`` at least.

Null and NaN are missing.  The table is read once a pass, so it should be a written one.
"""

from __future__ import annotations

import math
from collections.abc import Hashable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 512
#: values that may be counted one by one in a last pass
FEW = 20_000


class Summary(dict):
    """n, min, max and ``at`` (value by 0-based rank) of one column in one population."""

    def quantile(self, p: float) -> float | None:
        """Linear interpolation at position p (n - 1)."""
        if not self["n"]:
            return None
        at = p * (self["n"] - 1)
        low, high = self["at"][math.floor(at)], self["at"][math.ceil(at)]
        return low if math.floor(at) == math.ceil(at) else low + (high - low) * (at - math.floor(at))


def quantiles(df: DataFrame, columns: list[str], probs: list[float], by: str | None = None,
              populations: dict[Hashable, list | None] | None = None) -> dict[tuple[Hashable, str], Summary]:
    """(population, column) -> summary that knows the quantiles asked for.

    by: a column of few values; populations: the values of it that make up each one (None:
    all rows, null included).  Without populations there is one, None, of all rows.
    """
    populations = populations or {None: None}
    group = F.col(f"`{by}`").cast("string") if by else F.lit(None).cast("string")
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])
    long = df.select(group.alias("g"), F.explode(pairs).alias("e")).select("g", "e.*").where("v is not null and not isnan(v)")
    bounds = long.groupBy("g", "c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()

    groups = {p: None if v is None else [str(x) for x in v] for p, v in populations.items()}
    out, todo = {}, {}  # todo: (population, column, low, high) -> (rows before, ranks)
    sizes: dict[tuple, int] = {}  # rows between the bounds
    for p, members in groups.items():
        for i, c in enumerate(columns):
            own = [r for r in bounds if r["c"] == i and (members is None or r["g"] in members)]
            n = sum(r["n"] for r in own)
            lo, hi = (min(r["lo"] for r in own), max(r["hi"] for r in own)) if n else (None, None)
            out[p, c] = Summary(n=n, min=lo, max=hi, at={})
            ranks = {f(q * (n - 1)) for q in probs for f in (math.floor, math.ceil)} if n else set()
            _settle(out[p, c], todo, sizes, (p, c), lo, hi, 0, n, ranks)
    while todo:
        asked = list(todo.items())
        # a row for each bound still open: as many as there are populations, columns and quantiles, at most
        table = [(i, columns.index(c), lo, hi, groups[p]) for i, ((p, c, lo, hi), _) in enumerate(asked)]
        table = df.sparkSession.createDataFrame(table, "i int, c int, lo double, hi double, members array<string>")
        inside = (long["c"] == table["c"]) & F.col("v").between(F.col("lo"), F.col("hi")) & (F.col("members").isNull() | F.array_contains("members", F.col("g")))
        # halves, so that the difference of two finite doubles stays finite
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS), F.lit(PARTS - 1))
        few = sum(sizes[k] for k in todo) <= FEW  # so little is left that its values are counted one by one
        found = long.join(F.broadcast(table), inside).select("i", F.col("v").alias("part") if few else part.cast("int").alias("part"), "v")
        rows: dict[int, list] = {}
        for r in found.groupBy("i", "part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            rows.setdefault(r["i"], []).append(r)
        todo = {}
        for i, ((p, c, _, _), (before, ranks)) in enumerate(asked):
            for r in sorted(rows[i], key=lambda r: r["part"]):
                inside_part = {k for k in ranks if before <= k < before + r["n"]}
                _settle(out[p, c], todo, sizes, (p, c), r["lo"], r["hi"], before, r["n"], inside_part)
                before += r["n"]
    return out


def _settle(summary: Summary, todo: dict, sizes: dict, key: tuple, lo: float, hi: float, before: int, n: int, ranks: set[int]) -> None:
    """Ranks that the bounds decide, and the others for the next pass."""
    left = set()
    for k in ranks:
        if lo == hi or k == before:
            summary["at"][k] = lo
        elif k == before + n - 1:
            summary["at"][k] = hi
        else:
            left.add(k)
    if left:
        todo[(*key, lo, hi)], sizes[(*key, lo, hi)] = (before, left), n
