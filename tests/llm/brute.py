"""Plain versions of the operators, over small lists of (doc_id, text)."""

import re
import struct

import numpy as np
import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring(docs, k=50):
    """doc_id -> (words, kept words)."""
    first, out = {}, {}
    split = {d: words(t) for d, t in docs}
    for d in sorted(split):
        for i in range(len(split[d]) - k + 1):
            first.setdefault(tuple(split[d][i : i + k]), d)
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out[d] = (w, [x for x, g in zip(w, gone, strict=True) if not g])
    return out


def _hash(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _rolling(a, b):
    """xxhash64 of two longs, the second one seeded by the first."""
    return _hash(struct.pack("<Q", b), _hash(struct.pack("<Q", a)))


def lines(docs, every=4):
    """doc_id -> (lines, removed lines, kept text)."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        every_line = (t or "").split("\n")
        hashes = [_hash(x.encode()) for x in every_line]
        kept, removed, start = [], 0, 0
        for i in range(len(every_line)):
            rolling = _signed(_rolling(hashes[i], hashes[i - 1] if i else 0))
            if rolling % every == 0 or i == len(every_line) - 1:
                chunk = every_line[start : i + 1]
                body = "\n".join(chunk)
                if sum(x.strip(" ") != "" for x in chunk) > 1 and body in seen:
                    removed += len(chunk)
                else:
                    kept += chunk
                    if sum(x.strip(" ") != "" for x in chunk) > 1:
                        seen.add(body)
                start = i + 1
        out[d] = (len(every_line), removed, "\n".join(kept))
    return out


def fingerprint(text, size=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    hashes = [_hash(s.encode()) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs, radius=4):
    """doc_id -> (fingerprint, smallest doc_id reachable)."""
    ids = sorted(d for d, _ in docs)
    text = dict(docs)
    fps = np.array([fingerprint(text[d]) for d in ids], np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    return {d: (int(fps[i]), ids[find(i)]) for i, d in enumerate(ids)}
