"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams inside words (a space marks a word's ends), counted once
per document.  A feature's scale is the log ratio of its shares among toxic and other
documents; logistic regression then learns the weights of the scaled features.

Fitted on at most SAMPLE_ROWS labelled rows, chosen by a hash of doc_id, over their
whole texts; every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import per_process, saved, whole_row

SIZES = (3, 4, 5, 6)
BITS = 20               # hashed features: 2**BITS
SAMPLE_ROWS = 20_000    # bound on the labelled rows that the classifier is fitted on
FIT_TASKS = 8           # tasks that count the features of those rows
FEATURES = 16_384       # features kept: the most informative ones
LEAST_ROWS = 3          # rows a feature must occur in
SMOOTH = 1.0
PENALTY = 1e-4
SLICE_CHARS = 500_000


def _inside() -> np.ndarray:
    """Whether a code point belongs to a word; those past the basic plane do."""
    return per_process("alnum", lambda: np.array([chr(i).isalnum() for i in range(1 << 16)]))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram place, feature hashed to BITS bits."""
    joined = "".join(" " + t.lower() + " " for t in texts)
    lengths = np.array([len(t.lower()) + 2 for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    word = np.ones(len(codes), bool)
    low = codes < 1 << 16
    word[low] = _inside()[codes[low].astype(np.int64)]
    codes = np.where(word, codes + np.uint64(1), np.uint64(1))  # whatever parts words looks like a space
    rows, found = [], []
    total = codes.copy()
    middle = np.ones(len(codes), bool)  # all but the first and last letter of the n-gram are in a word
    for n in range(2, max(SIZES) + 1):
        total = total[:-1] + codes[n - 1 :] * np.uint64(pow(0x9E3779B97F4A7C15, n - 1, 1 << 64))
        middle = middle[:-1]
        if n > 2:
            middle = middle & word[n - 2 : len(codes) - 1]
        if n in SIZES:
            places = np.flatnonzero(middle)
            mixed = (total[places] ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
            rows.append(row[places])
    return np.concatenate(rows), np.concatenate(found)


def _slices(batches: Iterator[pa.RecordBatch], text_of) -> Iterator[tuple[pa.RecordBatch, list[str]]]:  # noqa: ANN001
    for batch in batches:
        texts = [x.as_py() or "" for x in text_of(batch)]
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= SLICE_CHARS or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


@dataclass
class Classifier:
    """Weights (scale times coefficient) of the kept features, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.index] = self.weight
        return out


def _present(texts: list[str], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) without repeats of the features where ``kept`` is true."""
    rows, found = features(texts)
    here = kept[found]
    both = np.unique(rows[here].astype(np.int64) << BITS | found[here])
    return both >> BITS, both & ((1 << BITS) - 1)


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): sample rows of each label that have the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, every = np.zeros((2, 1 << BITS), np.int64), np.ones(1 << BITS, bool)
        for part, texts in _slices(batches, lambda b: b.column(1)):
            rows, found = _present(texts, every)
            label = part.column(0).to_numpy(zero_copy_only=False)[rows]
            for k in (0, 1):
                seen[k] += np.bincount(found[label == k], minlength=1 << BITS)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])], ["feature", "toxic", "clean"])

    parts = sample.select("label", "text").repartition(FIT_TASKS).mapInArrow(run, "feature long, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _informative(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> tuple[Column, Column]:
    """Log-count ratio of a feature, and how far it tells the labels apart."""
    p, q = (toxic + SMOOTH) / (n_toxic + 2 * SMOOTH), (clean + SMOOTH) / (n_clean + 2 * SMOOTH)
    ratio = F.log(p / q)
    return ratio, (p - q) * ratio


def train(labelled: DataFrame, features_kept: int = FEATURES) -> Classifier:
    """Fit on (doc_id, text, label 0 or 1) rows; other labels and null ones are left out.

    features_kept: how many n-grams the classifier may use, the most informative ones of
    those that LEAST_ROWS sample rows have (ties go to the lower hash).

    Without rows of both labels the classifier gives the share of toxic rows to all.
    """
    rows = labelled.filter("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    sample = saved(rows.select("label", F.coalesce("text", F.lit("")).alias("text")), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log((n_toxic + 1e-3) / (n_clean + 1e-3))))
    ratio, worth = _informative(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    counts = _counts(sample).filter(F.col("toxic") + F.col("clean") >= LEAST_ROWS)
    kept = counts.select("feature", ratio.alias("ratio"), worth.alias("worth")).orderBy(F.desc("worth"), "feature").limit(features_kept).collect()
    kept.sort(key=lambda r: r["feature"])
    index, ratios = np.array([r["feature"] for r in kept], np.int64), np.array([r["ratio"] for r in kept])
    if not len(index):
        return Classifier(index, ratios, float(np.log(n_toxic / n_clean)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.zeros(1 << BITS, bool)
        chosen[index] = True
        for part, texts in _slices(batches, lambda b: b.column(1)):
            rows, found = _present(texts, chosen)
            ends = np.searchsorted(rows, np.arange(len(texts) + 1))
            at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.searchsorted(index, found), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.float64()), at], ["label", "at"])

    @F.udf(VectorUDT())
    def scaled(at: list[int]):  # noqa: ANN202
        return Vectors.sparse(len(index), at, ratios[at])

    vectors = saved(sample.mapInArrow(run, "label double, at array<int>"), "toxicity-features").select("label", scaled("at").alias("features"))
    fitted = LogisticRegression(regParam=PENALTY, standardization=False, maxIter=60).fit(vectors)
    return Classifier(index, fitted.coefficients.toArray() * ratios, float(fitted.intercept))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, fold: int = 2, folds: int = 4) -> DataFrame:
    """At most SAMPLE_ROWS documents with their label, without those held out.

    A row is held out if crc32 of its doc_id as text, modulo ``folds``, is ``fold``.  Of
    several labels of one document the largest counts.
    """
    open_rows = labels.filter(~held_out(F.col("doc_id"), fold, folds) & F.col(label).isin(0, 1))
    one = open_rows.groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # SAMPLE_ROWS narrow rows at most


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """(row: all columns of docs, score 0 to 1), one per input row.

    Null and empty texts have no feature and get the score of the intercept alone.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        chosen = table != 0
        for part, texts in _slices(batches, lambda b: b.column(0).field(at)):
            rows, found = _present(texts, chosen)
            total = np.bincount(rows, weights=table[found], minlength=len(texts)) + model.intercept
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-total)))], ["row", "score"])

    whole = docs.select(whole_row(docs))
    return whole.mapInArrow(run, T.StructType([whole.schema["row"], T.StructField("score", T.DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score stays under ``threshold``."""
    model = train(labelled_rows(docs, labels, "toxic"))
    return scored(docs, model).filter(F.col("score") < threshold).select("row.*")
