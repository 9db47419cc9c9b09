"""Registered queries of the subpackage: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import audit, bpe_codec, exact, html_text, importance, lines, nearest, packing, preference, sharding, simhash, substring, toxicity

WORD_BPE = "word_bpe_49k.json"
SEQUENCE = 2048
SHARDS = 24


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = substring.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return judged.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_codec.digests(bpe_codec.encode_decode(docs, public_tokenizers.path(WORD_BPE)))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), SEQUENCE)


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = preference.conversations(table(spark, sf_dir, "conversations"))
    return preference.digests(preference.formatted(preference.stale_pairs(talks)))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lines.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(spark, f"{sf_dir}/documents.parquet")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels"), "toxic"))
    return toxicity.scored(docs, model).select(
        "row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=[])
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), SHARDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe": op2_bpe,
    "op3_nearest": op3_nearest,
    "op4_packing": op4_packing,
    "op5_preference": op5_preference,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_html_text": op10_html_text,
    "op11_filter_audit": op11_filter_audit,
    "op12_importance": op12_importance,
    "op13_sharding": op13_sharding,
}
ORACLES: dict[str, str] = {
    "op5_preference": preference.ORACLE,
    "op7_exact_dedup": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
    "op11_filter_audit": audit.ORACLE,
    "op12_importance": importance.ORACLE,
    "op13_sharding": sharding.ORACLE,
}
