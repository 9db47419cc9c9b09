"""BPE encoding by forced-boundary splitting, and decoding.

Byte pairs that occur inside no vocabulary token can never be joined by a
merge, so a word may be cut there and its fragments encoded independently.
White-space runs are such cuts too: the pre-tokenizer drops them.  Each batch
encodes the fragments of all its new chunks at once, in numpy; chunks seen
before come from a bounded memo.

Null and empty texts give no ids.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer

from .store import per_process

# fixed values: Unicode White_Space, which the tokenizer's \s means
SPACE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
_SPLIT = re.compile(f"[{SPACE}]+")
_CONTROLS = re.compile("[\x1c-\x1f]")  # str.split() cuts there, the tokenizer doesn't

# Texts of these characters alone are normalised and pre-tokenized here: no
# combining marks, one lower-case letter each, classes that never changed.
_ACCENTED = f"{chr(0xC0)}-{chr(0xD6)}{chr(0xD8)}-{chr(0xF6)}{chr(0xF8)}-{chr(0x12F)}{chr(0x131)}-{chr(0x17F)}"
_PLAIN = re.compile(f"[\t-\r -~{chr(0xA1)}{chr(0xAB)}{chr(0xBB)}{chr(0xBF)}{_ACCENTED}]*")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_ACCENTED}]+|[0-9]|[^\\sa-z0-9{_ACCENTED}]+")

MEMO_ENTRIES = 600_000   # words and chunks kept per worker process
SLICE_WORDS = 40_000     # new chunks pre-tokenized at a time
SLICE_CHARS = 1_000_000  # text split at a time
NONE = np.int64(1 << 40)
NEWLINE = 10             # parts words in a batch; no word holds one


class MergeTable:
    """(left id, right id) -> (rank, merged id), looked up for whole arrays."""

    BITS = 19

    def __init__(self, pairs: np.ndarray, merged: np.ndarray) -> None:
        keys = (pairs[:, 0].astype(np.uint64) << np.uint64(32)) | pairs[:, 1].astype(np.uint64)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        first = np.searchsorted(slot[order], slot[order])
        depth = np.arange(len(order)) - first
        self.keys = np.full((int(depth.max(initial=0)) + 1, 1 << self.BITS), np.uint64(2**64 - 1))
        self.rank = np.full(self.keys.shape, NONE)
        self.keys[depth, slot[order]] = keys[order]
        self.rank[depth, slot[order]] = order
        self.merged = merged

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.full(len(keys), NONE)
        for k, r in zip(self.keys, self.rank, strict=True):
            hit = k[slot] == keys
            out[hit] = r[slot[hit]]
        return out


class Encoder:
    """Encoder and decoder of one tokenizer file (word-end BPE over bytes)."""

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        spec = json.loads(tokenizer.to_str())
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.normalize = tokenizer.normalizer.normalize_str
        self.pre_tokenize = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = [""] * tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = {bytes([b]): _letter(b) for b in range(256)}
        self.raw = np.zeros(max(map(ord, letters.values())) + 1, np.uint8)
        self.raw[[ord(x) for x in letters.values()]] = np.arange(256)
        self.raw[NEWLINE] = NEWLINE
        self.inner = np.array([vocab[x] for x in letters.values()])
        self.final = np.array([vocab[x + self.end] for x in letters.values()])
        pairs = np.array([[vocab[a], vocab[b]] for a, b in model["merges"]], np.int64)
        merged = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        made = np.zeros(len(self.tokens), np.int64)
        made[merged] = np.arange(len(merged))
        # a merge comes after those that make its parts: all places of the lowest pair can be joined at once
        if len(np.unique(merged)) < len(merged) or (made[pairs].max(axis=1) >= np.arange(len(pairs)))[1:].any():
            raise ValueError(f"{path}: merges are not in the order of their making")
        self.table = MergeTable(pairs, merged)
        #: joined[a, b]: bytes a, b stand side by side inside some token
        self.joined = np.zeros((256, 256), bool)
        for token in vocab:
            body = self.raw[[ord(c) for c in token.removesuffix(self.end)]]
            self.joined[body[:-1], body[1:]] = True
        self.memo: dict[str, bytes] = {}

    # --- words -----------------------------------------------------------

    def _fragments(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words, each symbol's fragment, and each fragment's word."""
        ends = np.flatnonzero(text == NEWLINE)
        word = np.cumsum(text == NEWLINE)
        inside = text != NEWLINE
        codes, word = text[inside], word[inside]
        last = ends - 1 - np.arange(len(ends))
        symbols = self.inner[codes]
        symbols[last] = self.final[codes[last]]
        cut = (word[1:] != word[:-1]) | ~self.joined[codes[:-1], codes[1:]]
        fragment = np.concatenate([[0], np.cumsum(cut)])
        return symbols, fragment, word[np.concatenate([[True], cut])]

    def _merge(self, symbols: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply the merges to every fragment; rounds over those still changing."""
        done_s, done_f = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
            rank = np.full(len(symbols), NONE)
            rank[:-1] = self.table.ranks(symbols[:-1], symbols[1:])
            rank[starts[1:] - 1] = NONE
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.concatenate([starts, [len(symbols)]]))
            best = np.repeat(best, sizes)
            live = best < NONE
            done_s.append(symbols[~live])
            done_f.append(fragment[~live])
            symbols, fragment, rank, best = symbols[live], fragment[live], rank[live], best[live]
            at = np.flatnonzero(rank == best)
            if not len(at):
                break
            # of overlapping places (a a a) every second one from the left
            run = np.concatenate([[True], np.diff(at) > 1])
            begin = np.maximum.accumulate(np.where(run, at, 0))
            at = at[(at - begin) % 2 == 0]
            symbols[at] = self.table.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, fragment = symbols[keep], fragment[keep]
        symbols, fragment = np.concatenate(done_s), np.concatenate(done_f)
        order = np.argsort(fragment, kind="stable")
        return symbols[order], fragment[order]

    def words(self, text: np.ndarray) -> list[bytes]:
        """Ids (little-endian uint32) of each word; the bytes of a word end with a newline."""
        if not len(text):
            return []
        symbols, fragment, word_of = self._fragments(text)
        symbols, fragment = self._merge(symbols, fragment)
        ends = np.cumsum(np.bincount(word_of[fragment])) * 4
        data = symbols.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn_plain(self, chunks: list[str]) -> None:
        """Add lower-cased chunks of plain texts to the memo."""
        words = [_WORDS.findall(x) for x in chunks]
        index: dict[str, int] = {}
        which = [[index.setdefault(w, len(index)) for w in ws] for ws in words]
        text = np.frombuffer("".join(w + "\n" for w in index).encode(), np.uint8)
        ids = self.words(text)
        self.memo.update((x, b"".join([ids[w] for w in ws])) for x, ws in zip(chunks, which, strict=True))

    # --- chunks (maximal runs without white space) of other texts ----------

    def _learn(self, chunks: list[str]) -> None:
        """Add chunks without special tokens to the memo, as SPACE + chunk."""
        for i in range(0, len(chunks), SLICE_WORDS):
            part = chunks[i : i + SLICE_WORDS]
            text = self.normalize("\n".join(part))
            ends = np.cumsum([len(x) + 1 for x in text.split(" ")])
            found = self.pre_tokenize(text)
            index: dict[str, int] = {}
            which = [index.setdefault(w, len(index)) for w, _ in found]
            letters = "".join(w + "\n" for w in index).encode("utf-32-le")
            ids = self.words(self.raw[np.frombuffer(letters, np.uint32)])
            chunk = np.searchsorted(ends, [a for _, (a, _) in found], side="right").tolist()
            out: list[list[bytes]] = [[] for _ in part]
            for c, w in zip(chunk, which, strict=True):
                out[c].append(ids[w])
            self.memo.update(zip([" " + x for x in part], map(b"".join, out), strict=True))

    def _special(self, chunk: str) -> bytes:
        parts = [x for x in self.special_cut.split(chunk) if x]
        self._learn([x for x in dict.fromkeys(parts) if x not in self.special and " " + x not in self.memo])
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self.memo[" " + x] for x in parts)

    def _cut(self, text: str) -> list[str]:
        """Memo keys of a text: its lower-cased chunks if it is plain, else its chunks after a space."""
        if _PLAIN.fullmatch(text) and not (self.special_cut and self.special_cut.search(text)):
            return text.lower().split()
        return [" " + x for x in (_SPLIT.split(text) if _CONTROLS.search(text) else text.split()) if x]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian uint32, in the order of the texts."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self._cut(text) if text else [])
            size += len(text or "")
            if size > SLICE_CHARS:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> Iterator[bytes]:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        keys = set().union(*held)
        new = keys.difference(self.memo)
        chunks = [x[1:] for x in new if x[0] == " "]
        odd = [x for x in chunks if self.special_cut and self.special_cut.search(x)]
        self._learn_plain([x for x in new if x[0] != " "])
        self._learn([*set(chunks).difference(odd)])
        for x in odd:
            self.memo[" " + x] = self._special(x)
        near = dict(zip(keys, map(self.memo.__getitem__, keys), strict=True))  # small enough for the processor's cache
        for chunks in held:
            yield b"".join(map(near.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space: the tokenizer file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _letter(byte: int) -> str:
    """The byte-level letter of a byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(byte) if byte in shown else chr(256 + sum(b not in shown for b in range(byte)))


def encoder(path: str) -> Encoder:
    """The worker's encoder of one file; its memo lives as long as the worker."""
    return per_process(("bpe", path), lambda: Encoder(path))
