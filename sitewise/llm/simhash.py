"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints at distance 4 or less have a common point at distance 2 or less
from both.  So every distinct fingerprint emits all 2,081 variants within two bits,
variants meet in a shuffle, and fingerprints that meet are verified and linked.

A variant's bucket is linear in its bits: some leading bits and some parities of the
others.  Variants of one fingerprint that fall into one bucket travel as the
fingerprint alone, and the bucket makes them again.  The parities spread a dense
group over many buckets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import partitions, saved

SEED = 42
PARITIES = 4                # parity bits of a bucket
VARIANTS_PER_BUCKET = 1 << 19
VARIANTS_AT_ONCE = 1 << 22  # a fuller bucket is worked off in passes
SLICE_CHARS = 1_000_000
BUCKET_BYTES = 32 << 20     # fingerprints per shuffle partition


def shingle_hashes(data: bytes, size: int) -> list[int]:
    """XXH64 of every ``size``-word shingle of ASCII-lower-cased UTF-8 text."""
    words = data.lower().split()  # bytes.split() cuts at 0x20 and 0x09-0x0D only
    text = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(text, SEED)] if words else []
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    digest = xxhash.xxh64_intdigest
    return [digest(text[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), (starts[size:] - 1).tolist(), strict=True)]


def _majority(hashes: list[int]) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): the 64-bit fingerprint of each whole text, as a signed long.

    Null texts and texts without a word have fingerprint zero; a text of fewer words
    than a shingle is one shingle.  Repeated rows give repeated fingerprints.
    """
    id_type = dict(docs.select("doc_id").dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_majority(shingle_hashes((x.as_py() or "").encode(), shingle)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp long")


class Buckets:
    """Which bucket a variant falls into, and which variants share one."""

    def __init__(self, leading: int, half: int) -> None:
        self.leading = leading
        flips = [sum(1 << b for b in bits) for k in range(half + 1) for bits in itertools.combinations(range(64), k)]
        self.masks = np.array(flips, np.uint64)
        low = (1 << (64 - leading)) - 1
        rng = np.random.default_rng(SEED)
        self.parity = [np.uint64(int(x) & low) for x in rng.integers(0, 2**63, PARITIES, np.uint64) * np.uint64(2) + np.uint64(1)]
        self.steps, which = np.unique(self.of(self.masks), return_inverse=True)
        self.masks_of = {int(s): self.masks[which == k] for k, s in enumerate(self.steps)}

    def of(self, values: np.ndarray) -> np.ndarray:
        out = (values >> np.uint64(64 - self.leading)).astype(np.int64)
        for m in self.parity:
            out = (out << 1) | (np.bitwise_count(values & m) & 1)
        return out

    def send(self, fps: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Buckets of all variants of the fingerprints, and the fingerprints each one gets."""
        bucket = (self.of(fps)[:, None] ^ self.steps[None, :]).ravel()
        order = np.argsort(bucket, kind="stable")
        bucket, sent = bucket[order], np.repeat(fps, len(self.steps))[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        return bucket[cuts], [x.tobytes() for x in np.split(sent, cuts[1:])] if len(cuts) else []

    def links(self, bucket: int, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the fingerprints of one bucket that share a variant in it."""
        fps = np.unique(fps)
        step = self.of(fps) ^ bucket
        root = np.arange(len(fps))
        made = sum(int((step == s).sum()) * len(m) for s, m in self.masks_of.items())
        passes = -(-made // VARIANTS_AT_ONCE)
        for k in range(passes):
            variants, nodes = [], []
            for s in np.unique(step).tolist():
                at = np.flatnonzero(step == s)
                masks = self.masks_of[s]
                rows = max(1, VARIANTS_AT_ONCE // len(masks))
                for i in range(0, len(at), rows):
                    part = at[i : i + rows]
                    v, n = (fps[part][:, None] ^ masks[None, :]).ravel(), np.repeat(part, len(masks))
                    if passes > 1:
                        here = _mixed(v) % np.uint64(passes) == k
                        v, n = v[here], n[here]
                    variants.append(v)
                    nodes.append(n)
            a, b = _meeting(np.concatenate(variants), np.concatenate(nodes))
            near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
            root = _joined(root, a[near], b[near])
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return fps[linked], fps[root[linked]]


def _mixed(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def _meeting(variants: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes with equal variants: each one with the least, without repeats.

    All nodes of one variant lie within the radius of each other, so links to the
    least join the same components as all pairs would.
    """
    slot = (variants * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)
    slot = slot.astype(np.int64)
    twice = np.bincount(slot, minlength=1 << 20)[slot] > 1  # most variants meet nobody
    variants, nodes = variants[twice], nodes[twice]
    order = np.lexsort((nodes, variants))
    variants, nodes = variants[order], nodes[order]
    first = np.concatenate([[True], variants[1:] != variants[:-1]]) if len(variants) else np.zeros(0, bool)
    least = nodes[first][np.cumsum(first) - 1] if len(variants) else nodes
    other = ~first & (nodes != least)
    pairs = np.unique(least[other].astype(np.int64) << 32 | nodes[other])
    return pairs >> 32, pairs & 0xFFFFFFFF


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each component after linking a to b."""
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for side in (a, b):
            np.minimum.at(after, side, low)
            np.minimum.at(after, root[side], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def near_links(distinct: DataFrame, count: int, radius: int = 4) -> DataFrame:
    """(u, v): links that join all fingerprints ``fp`` reachable by steps of ``radius`` bits.

    distinct: (fp long) without repeats; count: about its number of rows.
    """
    spark = distinct.sparkSession
    half = -(-radius // 2)
    variants = sum(len(list(itertools.combinations(range(64), k))) for k in range(half + 1))
    leading = max(6, (count * variants // VARIANTS_PER_BUCKET).bit_length() - PARITIES)
    shared = Buckets(leading, half)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, fps = shared.send(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(fps, pa.binary())], ["bucket", "fps"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(k, []).append(x)
        for k in list(held):
            u, v = shared.links(k, np.frombuffer(b"".join(held.pop(k)), np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    parts = partitions(spark, count * len(shared.steps) * 8, BUCKET_BYTES)
    sent = distinct.select("fp").mapInArrow(send, "bucket long, fps binary").repartition(parts, "bucket")
    return sent.mapInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest doc_id reachable over links, itself included.  Texts without words have
    fingerprint zero and link like any other.  A null doc_id takes part but names no
    component unless all its members are null; an empty table gives no rows; other
    columns are not read.
    """
    prints = saved(fingerprints(docs, shingle), "simhash-prints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    joined = components(near_links(distinct, distinct.count(), radius))
    rooted = distinct.join(joined, distinct.fp == joined.u, "left").select("fp", F.coalesce("v", "fp").alias("root"), "least_id")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_per_component(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The document of each component whose id names it, once; rows without an id all stay."""
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    once = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return once.unionByName(docs.filter("doc_id is null"))
