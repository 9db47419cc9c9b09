"""BPE encoding and decoding of whole texts (forced-boundary splitting, see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder

ROWS_OUT = 256  # documents per Arrow batch handed back: bounds a task's memory


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text and the text decoded from those ids.

    tokenizer: path of a ``tokenizers`` file with word-end BPE over bytes, readable
    on every executor.  Returns (id_col, ids binary: little-endian uint32, decoded
    string), one row per input row; a null or empty text gives no ids and the empty
    string.  Repeated rows are kept; other columns are not read.
    """
    id_type = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(i, ROWS_OUT)
                ids = list(codec.encode(part.column(1).to_pylist()))
                decoded = [codec.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of :func:`encode_decode`'s rows."""
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
