"""Filter audit, importance resampling and sharding against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sitewise.llm import audit, catalog, importance, sharding

from .test_edges import CLASH, LONG

SMALL = "/root/testdata/sf0.001"
HASHY = " ".join(f"w{i}" for i in range(250))
TEXTS = [(1, HASHY, "en"), (2, HASHY, "en"), (2, HASHY, None), (3, None, "en"), (4, "", "fr"), (5, "", ""), (6, " \t\n", "fr"), (7, LONG, "en"), (8, LONG, "fr"), (None, HASHY, "en"),
         (None, HASHY, "fr"), (9, "ABC# é " * 300, "en"), (10, "ABC# é " * 300, "en"), (9, "ABC# é " * 300, "en"), (11, "Ünï çödé 中文 \x1c x", None)]
LABELS = [(1, 1, 0), (2, 1, None), (2, 0, 1), (8, None, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1)]


def read(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("mine") for c in [*CLASH.split(), "h", "salt", "n", "mask", "weight", "rank", "size", "shard", "slot", "virtual_slot"]})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def plain_audit(docs, labels):
    """(part, order, step) -> the seven counts, each by its definition."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, toxic = ({d for d, q, t in labels if (q, t)[i] == 1 and d is not None} for i in (0, 1))
    failing = []
    for d, t, lang in docs:
        t = t or ""
        w = words(t)
        copy = d is not None and any(x is not None and x < d and (u or "") == t for x, u, _ in docs)
        checks = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), copy)
        failing.append((lang or "", d, {c for c, x in zip("ABCDE", checks, strict=True) if x}))
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in failing}:
        own = [(d, f) for p, d, f in failing if p == part]
        for order in map("".join, permutations("ABCDE")):
            for i, c in enumerate(order):
                here = [(d, f) for d, f in own if c in f and not f & set(order[:i])]
                shapley[part, c] += len(here)
                out[part, order, i + 1] = (
                    sum(not f & set(order[: i + 1]) for _, f in own), len(here), sum(c in f and bool(f & set(order[:i])) for _, f in own),
                    sum(f == {c} for _, f in own), sum(d in good for d, _ in here), sum(d in toxic for d, _ in here))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_of_odd_rows(docs, labels):
    assert found(audit.audit(docs, labels)) == plain_audit(TEXTS, LABELS)
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert found(audit.audit(docs, labels.limit(0))) == plain_audit(TEXTS, [])


def test_op11(spark):
    want = plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in read("documents")], [(r["doc_id"], r["quality"], r["toxic"]) for r in read("labels")])
    assert found(catalog.op11_filter_audit(spark, SMALL)) == want


def test_duplicates_with_and_without_split_groups(spark):
    # 3000 rows: texts of one, two and 1000 rows; only the last kind is split
    rows = [(i, f"t{i}" if i % 3 == 0 else f"p{i // 6}" if i % 3 == 1 else "hot") for i in range(3000)]
    own = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    got = {r.doc_id for r in audit.duplicates(own, own).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert got == {i for i, t in rows if first[t] < i}


def plain_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_importance(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    split = [(d, *plain_features(t)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in split for f in fs)
    t = Counter(bucket(f) for x in target for f in plain_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000.0) / ((s[b] + 1.0) * (t_all + 10000.0))))
    out = []
    for d, n, fs in split:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    left = [(*x, i + 1 if i < 5 * len(long) // 100 else None) for i, x in enumerate(long)]
    return sorted((*x[:1], *x[2:]) for x in [*left, *((*x, None) for x in out if x[1] < 20)])


def test_op12(spark):
    want = plain_importance([(r["doc_id"], r["text"]) for r in read("documents")], [r["text"] for r in read("benchmark")])
    got = sorted(tuple(r) for r in catalog.op12_importance(spark, SMALL).collect())
    assert got == want and sum(r[-1] is not None for r in got) > 0


def test_importance_of_odd_rows(spark, docs):
    many = docs
    for _ in range(2):
        many = many.unionAll(many)
    target = spark.createDataFrame([(HASHY,), (None,)], "text string")
    got = importance.resampled(many, target, percent=20)
    order = lambda x: tuple((v is None, v) for v in x)
    rows = [tuple(r) for r in got.select("row.doc_id", "n_features", "weight", "score").collect()]
    want = [x[:4] for x in plain_importance_any([(d, t) for d, t, _ in TEXTS] * 4, [HASHY, None])]
    assert sorted(rows, key=order) == sorted(want, key=order)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"] is not None)
    eligible = sum(plain_features(t)[0] >= 20 for _, t, _ in TEXTS) * 4
    assert ranks == list(range(1, 20 * eligible // 100 + 1))
    least = min(r.score for r in got.collect() if r["rank"] is not None)
    assert all(r["rank"] is not None or r.score <= least or r.n_words < 20 for r in got.collect())
    assert got.select("row.*").columns == ["doc_id", *[c for c in docs.columns if c != "doc_id"]]
    assert importance.resampled(docs.limit(0), target).count() == 0
    alone = importance.resampled(docs, target.limit(0))
    assert alone.count() == len(TEXTS)


def plain_importance_any(docs, target):
    """As :func:`plain_importance`, without an order of its rows (ids may be null)."""
    ids = {i: d for i, (d, _) in enumerate(docs)}
    s = Counter(zlib.crc32(f.encode()) % 10000 for _, t in docs for f in plain_features(t)[1])
    t = Counter(zlib.crc32(f.encode()) % 10000 for x in target for f in plain_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    for i, (_, text) in enumerate(docs):
        fs = plain_features(text)[1]
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000.0) / ((s[b] + 1.0) * (t_all + 10000.0)))) for b in (zlib.crc32(f.encode()) % 10000 for f in fs))
        h = int(hashlib.sha256(f"42:{'' if ids[i] is None else ids[i]}".encode()).hexdigest()[:8], 16)
        yield ids[i], len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def test_buckets_of_odd_words():
    rnd = random.Random(5)
    texts = ["", "Hello world", "x" * 70 + " b " + "y" * 200 + " " + "z" * 64 + " " + "q" * 65, "don't", "trail  ", "é中 Z9", "w" * 100_000 + " a"]
    texts += ["".join(rnd.choice("ab C9é ~\n😀") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    counts, found = importance.features(importance.Crc(), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 10_000)
    got, at = [], 0
    for n in counts:
        got.append(sorted(int(b) for f in found for b in f[at : at + n] if b >= 0))
        at += n
    assert got == [sorted(zlib.crc32(f.encode()) % 10_000 for f in plain_features(t)[1]) for t in texts]


@pytest.mark.parametrize("kinds", [1000, 3])
def test_kth_key_equals_the_sorted_one(spark, kinds):
    rnd = random.Random(kinds)
    rows = [(rnd.randrange(kinds), rnd.choice([None, *range(5)])) for _ in range(2000)]
    keys = spark.createDataFrame(rows, "a long, b long")
    # struct order: nulls first
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    for k in (1, 17, 1000, 2000):
        assert importance.kth_key(keys, ["a", "b"], k) == want[k - 1]
    assert importance.kth_key(keys, ["a", "b"], 2001) is None


def test_op13(spark):
    rows = catalog.op13_sharding(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in read("documents")}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    size, places = Counter(), {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 24
        assert r.virtual_slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        size[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(size.values()) - min(size.values()) <= max(r["size"] for r in rows)


def test_slot_maps_move_no_more_than_needed():
    rnd = random.Random(3)
    size = [rnd.randrange(1, 10_000) for _ in range(4096)]
    loads = lambda m, n: [sum(s for s, x in zip(size, m, strict=True) if x == i) for i in range(n)]
    first = sharding.round_robin(24, 4096)
    even = sharding.rebalanced(first, size, 24)
    before, after = loads(first, 24), loads(even, 24)
    assert max(after) - min(after) < 0.001 * sum(size) / 24 < max(before) - min(before)
    assert sum(a != b for a, b in zip(first, even, strict=True)) < 0.1 * 4096
    assert sharding.rebalanced(even, size, 24) != [] and sum(a != b for a, b in zip(even, sharding.rebalanced(even, size, 24), strict=True)) <= 24
    more = sharding.grown(even, size, 24)
    assert {b for a, b in zip(even, more, strict=True) if a != b} == {24}
    spread = loads(more, 25)
    assert max(spread) - min(spread) < 0.03 * sum(size) / 25


def test_slots_of_odd_rows(spark, docs, tmp_path):
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    got = sharding.sharded(docs, 3, 16, keep=keep, folder=str(tmp_path / "map"))
    rows = got.collect()
    assert got.select("row.*").columns == list(keep) and all(r.row["a.b"] == r.row["shard"] == "mine" for r in rows)
    assert sorted((r["size"], r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in TEXTS)
    for shard in range(3):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    versions = sharding.SlotMap(spark, str(tmp_path / "map"))
    stored = {r.virtual_slot: r.shard for r in versions.get(1).collect()}
    assert {r.virtual_slot: r.shard for r in versions.get(0).collect()} == {s: s % 3 for s in range(16)}
    assert all(stored[r.virtual_slot] == r.shard and r.map_version == 1 for r in rows)
    assert sharding.sharded(docs.limit(0), 3).count() == 0
