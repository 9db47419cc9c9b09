"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, substring dedup, packing.

``STAGES`` names the stages in order; ``run`` applies them to ``documents``, writing
each stage's result as Parquet in the shared folder and rereading it as the next
one's input.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitewise.llm import lines, packing, simhash, substring, toxicity
from sitewise.llm.catalog import SEQUENCE, WORD_BPE
from sitewise.llm.store import saved
from sitewise.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeated_chunks(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_component(docs, simhash.near_duplicates(docs, shingle=4, radius=4))


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs, k=50)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), SEQUENCE)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", dedup_passages),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing rounds.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
