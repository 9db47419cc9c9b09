"""Importance resampling towards a target distribution.

Features are runs of 1 to 3 words, counted in buckets of their CRC-32.  The counts of the
corpus and of the target give each bucket a gain, an array with as many numbers as there
are buckets; a document's weight is the sum of its features' gains.  With a Gumbel draw
by doc_id added, the highest scores are a sample without replacement.  The k-th of
them is found by distributed quickselect: each round draws random pivot keys from the
rows still in question, counts what lies before, on and after each pivot exactly, and
goes on between the two pivots that enclose the k-th key.  Only the rows up to that key
are sorted and numbered.

The CRC-32 of a run is made from those of its words, since that of a concatenation is a
linear function of the parts' (a table per length), so nothing is joined or hashed twice.

Nulls and odd rows: a null text holds no words; a row without doc_id is drawn with the
number of the empty id and comes last among equal scores.  Repeated rows are documents
of their own; of equal rows at the end of the sample as many are drawn as there is room
for.  Without a target (or an empty one) the gains are those of no target counts.  Empty
tables give no rows.  Columns other than doc_id, text and those to keep are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import row_numbers
from .sql import CRC_STEP, crc32
from .store import per_process, saved

BUCKETS = 10_000
LONGEST_RUN = 3
#: random pivot keys a round
PIVOTS = 16
#: bytes of text worked on at once
BLOCK = 1 << 22
#: up to this many bytes, a word is hashed together with all others and has a table of its length
SHORT = 64


class Crc:
    """CRC-32 of many byte strings at once, and of concatenations."""

    def __init__(self) -> None:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
        self.step = step
        # zeros[n, k, v]: the register with byte k equal to v and else 0, after n zero bytes
        own = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        zeros = [own]
        for _ in range(SHORT + 1):
            zeros.append(self.fed(zeros[-1], 0))
        self.zeros = np.stack(zeros).reshape(-1)

    def fed(self, register: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
        return self.step[(register ^ byte) & 255] ^ (register >> 8)

    def followed(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What ``crc`` adds to the CRC of its string followed by ``lengths`` bytes."""
        row = np.minimum(lengths, SHORT) * 1024
        out = np.zeros(len(crc), np.uint32)
        for k in range(4):
            out ^= self.zeros[row + (k * 256) + ((crc >> (8 * k)) & 255)]
        for i in np.flatnonzero(lengths > SHORT):
            left, part = int(lengths[i]) - SHORT, out[i : i + 1]
            while left:
                n = min(left, SHORT)
                part = self.followed(part, np.array([n]))
                left -= n
            out[i] = part[0]
        return out

    def spaced(self, crc: np.ndarray) -> np.ndarray:
        """The CRC of a string followed by one space."""
        return ~self.fed(~crc, 32)

    def of(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(-np.minimum(lengths, SHORT + 1).astype(np.int8), kind="stable")
        begin, size = starts[order], lengths[order]
        register = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for j in range(min(SHORT, int(size[0])) if len(size) else 0):
            n = int(np.searchsorted(-size, -j, side="left"))
            register[:n] = self.fed(register[:n], data[begin[:n] + j])
        out = np.empty(len(order), np.uint32)
        out[order] = ~register
        for i in np.flatnonzero(lengths > SHORT):
            out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes())
        return out


# bytes of words, after lower-casing: 0-9, a-z and everything beyond 0x7F
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
IN_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def features(crc: Crc, data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each document, and per run length the bucket of the run that starts at each word (-1: none).

    data: the documents' bytes one after another; offsets: where each begins, and the end.
    """
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = IN_WORD[low]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    # words of the document from this one on
    left = np.repeat(first[1:], counts) - np.arange(len(starts))

    word = crc.of(low, starts, lengths)
    runs, out = word, []
    for n in range(1, LONGEST_RUN + 1):
        if n > 1:
            runs = crc.followed(crc.spaced(runs[:-1]), lengths[n - 1 :]) ^ word[n - 1 :] if len(runs) else runs
        found = np.full(len(starts), -1, np.int64)
        found[: len(runs)] = runs % np.uint32(buckets)
        found[left < n] = -1
        out.append(found)
    return counts, out


def _blocks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts of a batch as (bytes, offsets), some megabytes at a time; a longer text stays whole."""
    texts = batch.column(at).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, marks, data = texts.buffers()
    offsets = np.frombuffer(marks, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK, side="right")) - 1)
        yield data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def _crc() -> Crc:
    return per_process("importance-crc", Crc)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket: ``buckets`` numbers, whatever the table's size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, offsets in _blocks(batch, 0):
                for found in features(_crc(), data, offsets, buckets)[1]:
                    total += np.bincount(found[found >= 0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    parts = texts.select("text").mapInArrow(counted, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: a thousand times the log ratio of its smoothed shares, rounded down."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (float(t + 1) * float(s_all + n)) / (float(s + 1) * float(t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all if None) as a struct ``row``, with n_words, n_features and weight."""
    keep = docs.columns if keep is None else keep
    given = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    schema = T.StructType([given.schema["row"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for data, offsets in _blocks(batch, 0):
                counts, found = features(_crc(), data, offsets, len(gain))
                ends = np.concatenate([[0], np.cumsum(counts)])
                each = sum((np.where(f >= 0, gain[f], 0) for f in found), np.zeros(int(ends[-1]), np.int64))
                sums = np.concatenate([[0], np.cumsum(each)])
                words.append(counts)
                runs.append(sum(np.maximum(counts - n, 0) for n in range(LONGEST_RUN)))
                weights.append(np.diff(sums[ends]))
            numbers = [pa.array(np.concatenate(x).astype(np.int64)) for x in (words, runs, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *numbers], schema.names)

    return given.mapInArrow(scored, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel variable that doc_id and seed decide, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth_key(keys: DataFrame, order: list[str], k: int) -> tuple | None:
    """The k-th key (from 1) of the rows by ``order``, ascending; None if there are fewer.

    Quickselect: each round asks for some rows at random between the bounds known so far
    and counts, in one aggregate, how many rows lie between and on them.
    """
    key = F.struct(*order)
    kinds = [keys.schema[c].dataType for c in order]

    def literal(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(values, kinds, order, strict=True)])

    low = high = None
    turn = 0
    while True:
        turn += 1
        left = keys
        if low is not None:
            left = left.filter(key > literal(low))
        if high is not None:
            left = left.filter(key < literal(high))
        drawn = left.orderBy(F.xxhash64(F.lit(turn), *order)).select(*order).limit(PIVOTS).distinct()
        # sorted by Spark, so that the driver compares as the counts do; at most PIVOTS rows
        pivots = [tuple(r) for r in drawn.orderBy(*order).collect()]
        if not pivots:
            return None
        marks = [literal(p) for p in pivots]
        place = sum(((key > m).cast("int") + (key >= m).cast("int") for m in marks), F.lit(0))
        counts = {r.place: r.n for r in left.select(place.alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect()}
        before, hit = 0, None
        for i in range(2 * len(pivots) + 1):
            if before + counts.get(i, 0) >= k:
                hit = i
                break
            before += counts.get(i, 0)
        if hit is None:
            return None
        if hit % 2:
            return pivots[hit // 2]
        k -= before
        low = pivots[hit // 2 - 1] if hit else low
        high = pivots[hit // 2] if hit // 2 < len(pivots) else high


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Every document's row with n_words, n_features, weight, score and rank (null: not drawn).

    percent: whole percents of the documents with at least ``least_words`` words to draw.
    keep: columns in the struct ``row`` besides doc_id (all if None).
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    kept = docs.columns if keep is None else ["doc_id", *keep]
    scores = weighed(docs, gain, kept)
    scores = scores.withColumns({"score": F.col("weight") + gumbel(F.col("row.doc_id"), seed), "doc_id": F.col("row.doc_id")})
    scores = saved(scores.withColumns({"last_first": -F.col("score"), "no_id": F.col("doc_id").isNull()}), "importance-scores")
    order = ["last_first", "no_id", "doc_id", "n_features"]
    eligible = scores.filter(F.col("n_words") >= least_words)
    k = percent * eligible.count() // 100
    end = kth_key(eligible.select(*order), order, k) if k else None
    none = F.lit(None).cast("long")
    columns = ["row", "n_words", "n_features", "weight", "score"]
    if end is None:
        return scores.select(*columns, none.alias("rank"))
    kinds = [scores.schema[c].dataType for c in order]
    last = F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(end, kinds, order, strict=True)])
    drawn = (F.col("n_words") >= least_words) & (F.struct(*order) <= last)
    ranked = row_numbers(scores.filter(drawn), order, "rank")
    ranked = ranked.select(*columns, F.when(F.col("rank") <= k, F.col("rank").cast("long")).alias("rank"))
    return ranked.unionByName(scores.filter(~drawn).select(*columns, none.alias("rank")))


ORACLE = f"""
    WITH {CRC_STEP},
    given AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
    found AS (
        SELECT side, id, row_number() OVER () AS nr,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM given),
    runs AS (
        SELECT side, nr, array_to_string(w[i:i + n - 1], ' ') AS run
        FROM (SELECT side, nr, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM found, (SELECT unnest([1, 2, 3]) AS n))),
    kinds AS (SELECT run, {crc32('run')} % 10000 AS bucket FROM (SELECT DISTINCT run FROM runs), step),
    held AS (SELECT bucket, side, nr, count(*) AS n FROM runs JOIN kinds USING (run) GROUP BY ALL),
    sums AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s_all, coalesce(sum(n) FILTER (side = 1), 0) AS t_all FROM held),
    gain AS (
        SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g
        FROM (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM held GROUP BY bucket), sums),
    sized AS (SELECT nr, sum(n) AS n_features, sum(n * g) AS weight FROM held JOIN gain USING (bucket) WHERE side = 0 GROUP BY nr),
    scored AS (
        SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
               coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
        FROM found LEFT JOIN sized USING (nr) WHERE side = 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed"""
