"""Substring dedup: words of long passages that an earlier document has too.

Windows of ``k`` consecutive words are grouped by super-k-mers: each window's
minimiser is the least hash of its ``m``-word grams, and consecutive windows that
share it travel as one packed string to the minimiser's bucket.  Equal windows have
equal minimisers, so each bucket sees all copies of its windows and counts them
exactly: it sorts window hashes and compares the bytes of those that agree.

A short line that is frequent in ever new surroundings would draw all windows around it
to one bucket.  So strings are counted by minimiser first, and windows with a hot one
go by the least hash of their longer grams, in the end by the hash of the window; which
minimisers are hot changes where windows meet, not what is found.

Tasks drop repeats of a string before the shuffle: of one passage a bucket gets one
string from each chunk of input, however many documents share it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import partitions, whole_row

GRAM = 8                 # words of a minimiser
CHUNK_BYTES = 12 << 20   # text whose strings are packed together
SLICE_BYTES = 1 << 20    # text hashed at a time
RUN = 4096               # windows in a string at most; longer runs go on in the next one
HOT_BYTES = 4 << 20      # text that a minimiser's strings have at most
PARTITION_BYTES = 64 << 20
BUCKETS = 8              # buckets per shuffle partition, worked off one by one
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: after all others

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash, modulo 2**64, of each stretch [start, end) of values."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(values)), dtype=np.uint64)])
    return _mix((total[ends] - total[starts]) * _powers(_INVERSE, len(values) + 1)[starts])


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each word; some words at a time, for the sums take many times the bytes."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + SLICE_BYTES)))
        out[i:j] = _sums(raw[a : ends[j - 1]].astype(np.uint64) + np.uint64(1), starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


class Words:
    """Words of some texts, each given as words joined by one space, and their hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        ends = np.flatnonzero((raw == 32) | (raw == 10))
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.text_of = np.concatenate([[0], np.cumsum(raw[ends] == 10)[:-1]])
        real = ends > starts  # an empty text has no word
        self.starts, self.ends, self.text_of = starts[real], ends[real], self.text_of[real]
        self.first = np.searchsorted(self.text_of, np.arange(len(texts)))
        self.hash = _word_hashes(raw, self.starts, self.ends)

    def windows(self, k: int) -> np.ndarray:
        """Whether a window of k words begins at each word."""
        out = np.zeros(len(self.starts), bool)
        if len(out) >= k:
            out[: len(out) - k + 1] = self.text_of[: len(out) - k + 1] == self.text_of[k - 1 :]
        return out

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, for as many as there are."""
        at = np.arange(max(0, len(self.hash) - k + 1))
        return _sums(self.hash, at, at + k)

    def slice(self, word: int, n: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word + n - 1]]


def gram_sizes(k: int) -> list[int]:
    """Words of the grams of each level: a window has a third as many on the next one, and one on the last."""
    grams = [k - min(GRAM, k) + 1]
    while grams[-1] > 1:
        grams.append(max(1, grams[-1] // 3))
    return [k - n + 1 for n in grams]


def _least_grams(words: Words, k: int, m: int) -> np.ndarray:
    """Least hash of the grams of m words in the k words from each word on."""
    least, width = words.grams(m), 1
    while width < k - m + 1:
        step = min(width, k - m + 1 - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return least


def minimisers(words: Words, k: int, hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, minimiser and its level of each window; hot: of each level, the minimisers to go on from."""
    begins = np.flatnonzero(words.windows(k))
    least, level = np.zeros(len(begins), np.uint64), np.zeros(len(begins), np.int64)
    rest = np.arange(len(begins))
    for i, m in enumerate(gram_sizes(k)):
        if not len(rest):
            break
        least[rest], level[rest] = _least_grams(words, k, m)[begins[rest]], i
        rest = rest[np.isin(least[rest], hot[i])] if i < len(hot) else rest[:0]
    return begins, least, level


def super_kmers(words: Words, k: int, hot: list[np.ndarray] = []) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:  # noqa: B006
    """First word, number of windows, minimiser and its level of each super-k-mer."""
    begins, least, level = minimisers(words, k, hot)
    new = np.ones(len(begins), bool)
    new[1:] = (least[1:] != least[:-1]) | (level[1:] != level[:-1]) | (begins[1:] != begins[:-1] + 1)
    head = np.flatnonzero(new)
    run = np.arange(len(begins)) - np.repeat(head, np.diff(np.concatenate([head, [len(begins)]])))
    head = np.flatnonzero(run % RUN == 0)
    return begins[head], np.diff(np.concatenate([head, [len(begins)]])), least[head], level[head]


Span = tuple[int, int, int, int]  # doc, text hash, first word, word after the last


def _pack(strings: list[tuple[bytes, int, list[tuple[int, int, int]]]], spans: list[Span]) -> bytes:
    """(string, windows, [(doc, text hash, first word)]) of one bucket, and spans already known."""
    places = [(i, *p) for i, (_, _, ps) in enumerate(strings) for p in ps]
    numbers = [np.array([n for _, n, _ in strings], "<i8"), np.array([len(s) for s, _, _ in strings], "<i8"), np.array(places, "<i8"), np.array(spans, "<i8")]
    head = struct.pack("<3q", len(strings), len(places), len(spans))
    return zstandard.compress(head + b"".join(x.tobytes() for x in numbers) + b"".join(s for s, _, _ in strings), 3)


def _unpack(blob: bytes) -> tuple[list[tuple[bytes, int]], np.ndarray, np.ndarray]:
    data = zstandard.decompress(blob)
    n, p, s = struct.unpack_from("<3q", data)
    numbers = np.frombuffer(data, "<i8", 2 * n + 4 * p + 4 * s, 24)
    windows, sizes = numbers[:n], numbers[n : 2 * n]
    ends = 24 + numbers.nbytes + np.cumsum(sizes)
    strings = [(data[b - z : b], w) for b, z, w in zip(ends.tolist(), sizes.tolist(), windows.tolist(), strict=True)]
    return strings, numbers[2 * n : 2 * n + 4 * p].reshape(-1, 4), numbers[2 * n + 4 * p :].reshape(-1, 4)


def _slices(rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, Words]]:
    """Number of the first row, and the words, of some rows at a time."""
    i = 0
    while i < len(rows):
        j, size = i, 0
        while j < len(rows) and size < SLICE_BYTES:
            size += len(rows[j][2])
            j += 1
        yield i, Words([x[2] for x in rows[i:j]])
        i = j


def _weights(rows: list[tuple[int, int, bytes]], k: int, hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers of the level after the hot ones, with the bytes of their different strings; those with one are left out."""
    found = []
    for _, words in _slices(rows):
        heads, counts, least, level = super_kmers(words, k, hot)
        here = level == len(hot)
        heads, last, least = heads[here], (heads + counts + k - 1)[here], least[here]
        found.append(np.column_stack([least, _sums(words.hash, heads, last), (words.ends[last - 1] - words.starts[heads]).astype(np.uint64)]))
    strings = np.concatenate([np.zeros((0, 3), np.uint64), *found])
    strings = strings[np.lexsort((strings[:, 1], strings[:, 0]))]
    other = np.ones(len(strings), bool)
    other[1:] = (strings[1:, :2] != strings[:-1, :2]).any(axis=1)
    keys, at, n = np.unique(strings[other, 0], return_index=True, return_counts=True)
    sizes = np.add.reduceat(strings[other, 2], at) if len(at) else np.zeros(0, np.uint64)
    return keys[n > 1], sizes[n > 1]


def _chunk(rows: list[tuple[int, int, bytes]], k: int, buckets: int, hot: list[np.ndarray] = []) -> Iterator[tuple[int, bytes]]:  # noqa: B006
    """Packed strings by bucket of (doc, text hash, words joined by a space) rows."""
    seen: dict[bytes, tuple[int, int, list[tuple[int, int, int]]]] = {}
    known: dict[int, list[Span]] = {}
    for i, words in _slices(rows):
        heads, counts, least, _ = super_kmers(words, k, hot)
        text = words.text_of[heads]
        cuts = zip(words.starts[heads].tolist(), words.ends[heads + counts + k - 2].tolist(), counts.tolist(), (least % np.uint64(buckets)).tolist(), text.tolist(), (heads - words.first[text]).tolist(), strict=True)
        for a, b, n, bucket, t, at in cuts:
            doc, mark, _ = rows[i + t]
            string = words.data[a:b]
            had = seen.get(string)
            if had is None or doc < had[2][0][0]:
                if had is not None:  # the holders so far have an earlier document now
                    known.setdefault(bucket, []).extend((d, x, p, p + n + k - 1) for d, x, p in had[2])
                seen[string] = (n, bucket, [(doc, mark, at)])
            elif doc == had[2][0][0]:
                had[2].append((doc, mark, at))
            else:
                known.setdefault(bucket, []).append((doc, mark, at, at + n + k - 1))
    by: dict[int, list] = {}
    for string, (n, bucket, places) in seen.items():
        by.setdefault(bucket, []).append((string, n, places))
    seen.clear()
    for bucket in by.keys() | known.keys():
        yield bucket, _pack(by.pop(bucket, []), known.pop(bucket, []))


def _bucket(blobs: Iterable[bytes], k: int) -> Iterator[Span]:
    """Spans of all windows of one bucket that an earlier document has."""
    index: dict[bytes, int] = {}
    windows: list[int] = []
    places = []
    for blob in blobs:
        strings, at, spans = _unpack(blob)
        yield from map(tuple, spans.tolist())
        for s, n in strings:
            if s not in index:
                index[s] = len(index)
                windows.append(n)
        ids = np.array([index[s] for s, _ in strings], np.int64)
        places.append(np.column_stack([ids[at[:, 0]], at[:, 1:]]) if len(at) else at)
    if not index:
        return
    all_places = np.concatenate(places)
    least = np.full(len(index), LAST)
    np.minimum.at(least, all_places[:, 0], all_places[:, 1])
    words = Words(list(index))
    begins = np.flatnonzero(words.windows(k))
    found = words.grams(k)[begins]
    slot = (found >> np.uint64(44)).astype(np.int64)
    twice = np.bincount(slot, minlength=1 << 20)[slot] > 1
    begins, found = begins[twice], found[twice]
    order = np.argsort(found, kind="stable")
    begins, found = begins[order], found[order]
    doc = least[words.text_of[begins]]
    repeated = _earlier(words, begins, found, doc, k)
    first = words.first
    marks: dict[int, list[int]] = {}
    for w in np.sort(begins[repeated]).tolist():
        marks.setdefault(int(words.text_of[w]), []).append(w)
    for s, d, mark, at in all_places.tolist():
        if d > least[s]:
            yield d, mark, at, at + windows[s] + k - 1
        else:
            for a, b in _runs(marks.get(s, [])):
                yield d, mark, at + a - int(first[s]), at + b - int(first[s]) + k


def _earlier(words: Words, begins: np.ndarray, found: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Of windows sorted by hash: those whose bytes a window of an earlier document has."""
    out = np.zeros(len(begins), bool)
    if not len(begins):
        return out
    heads = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(found)]]))
    low, high = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
    for g in np.flatnonzero(low < high).tolist():
        rows = range(heads[g], heads[g] + sizes[g])
        texts = [words.slice(begins[r], k) for r in rows]
        least: dict[bytes, int] = {}
        for r, t in zip(rows, texts, strict=True):
            least[t] = min(least.get(t, LAST), int(doc[r]))
        for r, t in zip(rows, texts, strict=True):
            out[r] = doc[r] > least[t]
    return out


def _runs(sorted_words: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each stretch of consecutive numbers."""
    start = None
    for w in sorted_words:
        if start is None or w != last + 1:
            if start is not None:
                yield start, last
            start = w
        last = w
    if start is not None:
        yield start, last


def _estimated_bytes(df: DataFrame) -> int:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0  # Spark's "unknown" is 8 EiB


def _texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(doc, mark, words joined by a space) of texts with a window, a chunk at a time."""
    rows, size = [], 0
    for batch in batches:
        for doc, mark, text in zip(*batch.columns, strict=True):
            words = (text.as_py() or "").encode().split()
            if len(words) >= k:
                rows.append((doc.as_py(), mark.as_py(), b" ".join(words)))
                size += len(rows[-1][2])
            if size >= CHUNK_BYTES:
                yield rows
                rows, size = [], 0
    yield rows


def hot_minimisers(docs: DataFrame, k: int) -> list[np.ndarray]:
    """Of each level, the minimisers whose strings are too much for one bucket; the last level has none."""
    hot: list[np.ndarray] = []
    while len(hot) < len(gram_sizes(k)) - 1:
        known = list(hot)

        def weigh(batches: Iterator[pa.RecordBatch], known: list[np.ndarray] = known) -> Iterator[pa.RecordBatch]:
            for rows in _texts(batches, k):
                keys, sizes = _weights(rows, k, known)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sizes.astype(np.int64))], ["least", "size"])

        sizes = docs.select("doc", "mark", "text").mapInArrow(weigh, "least long, size long").groupBy("least").agg(F.sum("size").alias("size"))
        found = sizes.filter(F.col("size") > HOT_BYTES).select("least").collect()  # at most one for each HOT_BYTES of strings
        if not found:
            break
        hot.append(np.sort(np.array([r.least for r in found], np.int64).view(np.uint64)))
    return hot


def repeated_spans(docs: DataFrame, k: int = 50) -> DataFrame:
    """(doc, mark, first, last): word spans [first, last) covered by earlier documents' windows.

    docs: (doc long, mark long, text string), mark telling apart texts of one doc.
    Spans of a document may overlap.
    """
    spark = docs.sparkSession
    parts = partitions(spark, 10 * _estimated_bytes(docs), PARTITION_BYTES)  # strings overlap: thrice the text, compressed here
    buckets = parts * BUCKETS
    hot = hot_minimisers(docs, k)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _texts(batches, k):
            found = list(_chunk(rows, k, buckets, hot))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["bucket", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(b, []).append(x)
        for b in list(held):
            spans = np.array(list(_bucket(held.pop(b), k)), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(spans[:, i]) for i in range(4)], ["doc", "mark", "first", "last"])

    packed = docs.select("doc", "mark", "text").mapInArrow(send, "bucket long, packed binary").repartition(parts, "bucket")
    return packed.mapInArrow(meet, "doc long, mark long, first long, last long")


def _cutter(text_at: int):  # noqa: ANN202
    """For (row, spans) batches: the row with n_words, n_removed and the kept words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                out: list[tuple[int, int, str]] = []
                for text, spans in zip(part.column(0).field(text_at), part.column(1), strict=True):
                    words = (text.as_py() or "").encode().split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s in spans.as_py() or []:
                        gone[s["first"]] += 1
                        gone[s["last"]] -= 1
                    keep = np.cumsum(gone)[:-1] == 0
                    out.append((len(words), int((~keep).sum()), b" ".join(w for w, x in zip(words, keep.tolist(), strict=True) if x).decode()))
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                    ["row", "n_words", "n_removed", "kept"])

    return cut


def _judged(docs: DataFrame, k: int) -> DataFrame:
    """(row: all columns of docs, n_words, n_removed, kept)."""
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc"), F.xxhash64("text").alias("mark"), whole_row(docs))
    spans = repeated_spans(keyed.select("doc", "mark", F.col("row.text").alias("text")), k)
    spans = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = keyed.join(spans, ["doc", "mark"], "left").select("row", "spans")
    added = [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()))]
    return joined.mapInArrow(_cutter(docs.columns.index("text")), T.StructType([joined.schema["row"], *added]))


def remove_repeats(docs: DataFrame, k: int = 50) -> DataFrame:
    """doc_id and text with n_words, n_removed and ``kept``, one row per input row.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  Every word is removed that
    lies in a window of k words which also begins in a document of smaller doc_id, as
    the input has it; kept words are joined by one space.  Null texts have no words.
    A null doc_id counts as larger than all others.  Rows with equal doc_id don't
    remove from each other.  An empty table gives no rows; other columns are not read.
    """
    return _judged(docs.select("doc_id", "text"), k).select("row.doc_id", "row.text", "n_words", "n_removed", "kept")


def without_repeats(docs: DataFrame, k: int = 50) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; documents left without a word go.

    Untouched texts stay as they are, others become their kept words.  All columns
    of the input return, n_chars (if there) counting the new text.
    """
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    left = _judged(docs, k).filter("n_removed = 0 or n_removed < n_words")
    return left.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
