"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir as shared_dir
from ..session import written as saved

__all__ = ["forget", "partitions", "per_process", "saved", "shared_dir", "whole_row"]


def per_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a worker process.

    The package's code travels inside task closures, so each task has module
    variables of its own; only a module that workers import is shared by them.
    """
    kept = sys.__dict__.setdefault("_sitewise_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``: names of the caller's columns can't clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def forget(df: DataFrame) -> None:
    """Delete the files of a frame from :func:`saved` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_dir(spark).split(":")[-1]
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession, total: int, each: int) -> int:
    """Shuffle partitions so that one holds about ``each`` of ``total`` units."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // each))
