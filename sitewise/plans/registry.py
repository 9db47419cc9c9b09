"""Query registry: every named query is a Spark callable plus, where the
result is SQL-expressible, an independent SQL twin used as an oracle."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import release_cached

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ids: str


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release_cached()  # the previous query's intermediates
            return fn(spark, sf_dir)

        REGISTRY[name] = Query(name, run, sql, ids)
        return run

    return deco


def dist_sql(a: str, b: str, alat: str = "lat", alon: str = "lon", blat: str = "lat", blon: str = "lon") -> str:
    """Flat distance in km as SQL text, same operation order as the Spark form."""
    dy = f"(({a}.{alat} - {b}.{blat}) * 111)"
    dx = f"(({a}.{alon} - {b}.{blon}) * 88)"
    return f"sqrt({dy} * {dy} + {dx} * {dx})"
