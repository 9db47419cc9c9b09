"""Main text of web pages: structure marks regions, a host's suffix array finds boilerplate.

Pages are cut into blocks of text, each in a region: ``marked`` (menus, headers, footers,
sidebars, notices, adverts, forms, comments), ``main`` (inside an article) or ``plain``.
Marked blocks go.  Per host, the streams of the other blocks' tokens are concatenated and
their suffixes sorted, to the depth of a run; what many different pages share is
boilerplate: whole blocks, long runs and, in nearly all pages, short runs.

Pages with the same stream are one page, and so are near-copies: pages that share at
least half of their short runs with a page before.  So neither copies of an article nor
of a text without markup make it boilerplate, whatever adverts they carry.  In an
article far more pages must share a block than elsewhere, for paragraphs are quoted.

A host of more than ``PAGES`` pages is judged as a whole too, by many tasks (:func:`_large`).  The first
tokens of all its suffixes travel as hashes to the partitions of the host's suffix array, which is in
their order; neighbours there tell which runs different pages share.  Pages with enough shared
runs may be near-copies, and shared runs that enough pages hold may be boilerplate or within it.  Both are
few; they are compared and counted over the whole host, and what is boilerplate goes back to
the pages.  Hashes have 48 bits and more, so many that a host's runs seldom meet by chance, and
never enough of them to reach a threshold.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import partitions, saved

RUN = 6               # tokens a repeated run or block has at least
LONG = 24             # tokens a long run has at least
PAGES = 400           # pages of a host that one task takes, on average; a host of more is judged by many tasks
BUCKET_PAGES = 800    # pages of a large host whose runs one partition of its suffix array has room for, on average
HELD_RUNS = 6 << 20   # runs of large hosts that a task holds before it sends them
COPY = 0.5            # part of a page's runs that a near-copy shares
# different pages that share it: at least so many, and this part of all
SHORT_RUNS = (8, 0.8)
LONG_RUNS = {"plain": (3, 0.1)}
BLOCKS = {"plain": (3, 0.1), "main": (8, 0.3)}
COLUMNS = 4096        # sets of pages compared at a time
PARTITION_BYTES = 16 << 20

# fixed values: elements of HTML
RAW = frozenset("script style title textarea noscript iframe template svg math object select option xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"br", "button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "head", "body"}
CHROME = frozenset("aside button dialog fieldset footer form head header menu nav search".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
#: names that wrappers and paragraphs of text have too: they mark as a whole class name only, and not in an article
VAGUE = frozenset("banner copyright header login menu modal notice notices popup promo promotion related share sharing social widget widgets".split())
#: a name with such a part tells the state of a layout
STATES = frozenset("has hide is no not show with without".split())
#: an article within these isn't the page's
BARRING = frozenset("aside comment comments complementary contentinfo disqus footer nav navigation".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


def _mark(name: str, attributes: str, area: str) -> str | None:
    """The tag, role, class or id that marks an element in this area, if one does."""
    if name in CHROME:
        return name
    if name in ("html", "body", "main", "article"):
        return None
    for key, value in _ATTRIBUTE.findall(attributes):
        for token in value.lower().strip("\"'").split():
            words = _NAME.findall(token)
            if not words:
                continue
            if key.lower() == "role":
                if words[0] in CHROME_ROLES:
                    return words[0]
                break
            if len(words) == 1:
                told = [w for w in words if w in CHROME_NAMES and (area != "main" or w not in VAGUE)]
            else:
                ends = words[-1:] if area == "main" else [words[-1], words[0]]
                told = [w for w in ends if w in CHROME_NAMES - VAGUE] if STATES.isdisjoint(words) else []
            if told:
                return told[0]
    return None


State = tuple[str, tuple[int, ...], bool]  # area, numbers of the marking elements around, whether one of them bars articles
START: State = ("plain", (), False)


def blocks(page: str) -> list[tuple[str, str]]:
    """(region, text) of the page's blocks in order; white space is one space, references decoded.

    An article or main element is unmarked whatever its wrappers are called, unless it
    lies in a menu, sidebar, footer or comments.  A mark doesn't hold for an element that
    wraps an article, nor for one with most words of an article or of a page without one.
    """
    out: list[tuple[State, str]] = []
    open_tags: list[tuple[str, State]] = []
    held: list[str] = []
    state, at = START, 0
    areas: list[str] = []  # of each marking element
    wide: set[int] = set()

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((state, text))

    def within(name: str, attributes: str, above: State) -> State:
        area, marks, barred = above
        if name in ("article", "main"):
            if barred:
                return above
            wide.update(marks)
            return "main", (), False
        told = _mark(name, attributes, area)
        if told is None:
            return above
        areas.append(area)
        return area, (*marks, len(areas) - 1), barred or told in BARRING

    while at < len(page):
        tag = _MARKUP.search(page, at)
        if tag is None:
            held.append(page[at:])
            break
        held.append(page[at : tag.start()])
        at = tag.end()
        ending, name = tag[1], (tag[2] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not ending and not tag[3].rstrip().endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in BLOCK:
            close()
        if ending:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    if open_tags[i][1] != state or name in BLOCK:
                        close()
                    del open_tags[i:]
                    break
        elif name not in VOID:
            if name in ENDS_P and any(n == "p" for n, _ in open_tags):
                last = max(i for i, (n, _) in enumerate(open_tags) if n == "p")
                if all(n not in BLOCK for n, _ in open_tags[last + 1 :]):
                    del open_tags[last:]
                    state = open_tags[-1][1] if open_tags else START
            inner = within(name, tag[3], open_tags[-1][1] if open_tags else START)
            if inner != state:
                close()
            open_tags.append((name, inner))
        state = open_tags[-1][1] if open_tags else START
    close()
    if areas:
        _widen(out, areas, wide)
    return [("marked" if barred or not wide.issuperset(marks) else area, text) for (area, marks, barred), text in out]


def _widen(found: list[tuple[State, str]], areas: list[str], wide: set[int]) -> None:
    """Add to ``wide`` the marking elements with most of the words that aren't barred."""
    words, total = [0] * len(areas), {"main": 0, "plain": 0}
    for (area, marks, barred), text in found:
        if not barred:
            n = text.count(" ") + 1
            total[area] += n
            for m in marks:
                words[m] += n
    for m, area in enumerate(areas):
        if 2 * words[m] > total[area] and (area == "main" or not total["main"]):
            wide.add(m)


def _prefix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix in the suffix array sorted to ``depth`` tokens, by prefix doubling."""
    rank, width = tokens, 1
    while width < depth:
        step = min(width, depth - width)
        after = np.full(len(rank), -1)
        after[: max(0, len(rank) - step)] = rank[step:]
        _, rank = np.unique(rank.astype(np.int64) << 32 | (after + 1), return_inverse=True)
        width += step
    return rank


def _suffixes(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids, stream of each and whether it is the border after one, all streams in a row."""
    index: dict[str, int] = {}
    tokens, owner = [], []
    for i, words in enumerate(streams):
        tokens += [index.setdefault(w, len(index)) for w in words]
        tokens.append(-1)
        owner += [i] * (len(words) + 1)
    ids, stream = np.array(tokens, np.int64), np.array(owner, np.int64)
    border = ids < 0
    ids[border] = len(index) + np.arange(border.sum())  # a different one after each stream
    return ids, stream, border


def shared_by(streams: list[list[str]], depth: int = RUN, pages: np.ndarray | None = None) -> list[np.ndarray]:
    """For each token of each stream: how many pages share a run of ``depth`` tokens over it.

    At least 1; pages: the page that each stream is of (by default its own).
    """
    ids, stream, border = _suffixes(streams)
    page = stream if pages is None else pages[stream]
    rank = _prefix_ranks(ids, depth)
    pairs = np.unique(rank << 32 | page)
    count = np.bincount(pairs >> 32, minlength=len(rank))[rank]
    count[max(0, len(ids) - depth + 1) :] = 1  # no whole run begins there
    most, width = count.copy(), 1
    while width < depth:  # a run covers its first token and those after it
        step = min(width, depth - width)
        most[step:] = np.maximum(most[step:], most[:-step].copy())
        width += step
    return [x[:-1] for x in np.split(most, np.flatnonzero(border)[:-1] + 1)]


def different_pages(streams: list[list[str]]) -> np.ndarray:
    """For each stream the first one that it is a near-copy of, or itself."""
    n = len(streams)
    first = np.arange(n)
    ids, stream, border = _suffixes(streams)
    rank = _prefix_ranks(ids, RUN)
    left = np.flatnonzero(border)[stream] - np.arange(len(ids))
    pairs = np.unique((rank << 32 | stream)[left >= RUN])
    if not len(pairs):
        return first
    page = pairs & 0xFFFFFFFF
    heads = np.flatnonzero(np.concatenate([[True], np.diff(pairs >> 32) != 0]))
    held = np.diff(np.concatenate([heads, [len(pairs)]]))
    runs = np.bincount(page, minlength=n)
    # runs with the same set of pages are one column, told by a sum of random numbers
    sets = np.add.reduceat(np.random.default_rng(0).integers(0, 1 << 64, n, np.uint64)[page], heads)
    some = np.flatnonzero(held > 1)
    _, one, weight = np.unique(sets[some], return_index=True, return_counts=True)
    common = np.zeros((n, n), np.float32)
    for i in range(0, len(one), COLUMNS):
        part = some[one[i : i + COLUMNS]]
        column = np.repeat(np.arange(len(part)), held[part])
        at = np.repeat(heads[part] - np.concatenate([[0], np.cumsum(held[part])[:-1]]), held[part]) + np.arange(held[part].sum())
        holds = np.zeros((n, len(part)), np.float32)
        holds[page[at], column] = np.sqrt(weight[i : i + COLUMNS])[column]
        common += holds @ holds.T
    alike = common >= COPY * np.maximum(runs[:, None], runs[None, :]) - 0.01
    alike &= runs[:, None] > 0
    for i in range(1, n):
        before = np.flatnonzero(alike[i, :i] & (first[:i] == np.arange(i)))
        if len(before):
            first[i] = before[0]
    return first


def stream_id(words: tuple[str, ...]) -> int:
    """64 bits that name a page's stream; near-copies are looked for in the order of these numbers."""
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_texts(pages: list[list[tuple[str, str]]]) -> list[str]:
    """Main text of each page of one host, given its blocks."""
    worded = [[(region, tuple(text.split())) for region, text in page if region != "marked"] for page in pages]
    streams = [tuple(w for _, words in page for w in words) for page in worded]
    number = {x: i for i, x in enumerate(sorted(set(streams), key=lambda x: (stream_id(x), x)))}
    distinct = [list(x) for x in number]
    page_of = different_pages(distinct)
    total = len(set(page_of.tolist()))
    holders: dict[tuple[str, ...], set[int]] = {}
    for page, stream in zip(worded, streams, strict=True):
        for _, words in page:
            if len(words) >= RUN:
                holders.setdefault(words, set()).add(int(page_of[number[stream]]))

    def enough(rule: tuple[int, float]) -> float:
        return max(rule[0], rule[1] * total)

    nearly_all = enough(SHORT_RUNS)
    long_runs, whole = ({region: enough(rule) for region, rule in x.items()} for x in (LONG_RUNS, BLOCKS))
    short, long = (shared_by(distinct, depth, page_of) for depth in (RUN, LONG))
    out = []
    for page, stream in zip(worded, streams, strict=True):
        at, kept = 0, []
        for region, words in page:
            here = slice(at, at + len(words))
            at += len(words)
            if len(holders.get(words, ())) < whole[region]:
                gone = short[number[stream]][here] >= nearly_all
                if region in long_runs:
                    gone |= long[number[stream]][here] >= long_runs[region]
                kept += [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        out.append(" ".join(kept))
    return out


def _unmarked(page: str | None) -> list[tuple[str, str]]:
    return [(region, text) for region, text in blocks(page or "") if region != "marked"]


def run_hashes(streams: list[list[str]], depth: int) -> list[np.ndarray]:
    """Hash of the run of ``depth`` tokens at each place of each stream where a whole one begins."""
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for words in streams for w in words], np.int64)
    of_word = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in index), np.uint64)
    tokens = of_word[ids] if len(ids) else np.zeros(0, np.uint64)
    whole = max(0, len(tokens) - depth + 1)
    x = np.zeros(whole, np.uint64)
    for i, factor in enumerate(np.random.default_rng(depth).integers(0, 1 << 63, depth, np.uint64) * 2 + 1):
        x += tokens[i : i + whole] * factor
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    out, at = [], 0
    for words in streams:
        out.append(x[at : at + max(0, len(words) - depth + 1)])
        at += len(words)
    return out


def _named(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Names of runs: 48 bits of the hash, and the bits that choose its bucket."""
    low = np.uint64(0xFFFF)
    return (hashes & ~low) | (hashes & np.uint64(buckets - 1))


class _Chunk:
    """Different streams of a host in one task, and their runs."""

    def __init__(self, buckets: int):
        self.buckets, self.runs = buckets, []
        self.plain: dict[int, bool] = {}  # stream -> whether a block of it is plain

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, streams, what they hold there); bucket -1 has the number of runs of each stream and whether it is plain."""
        low = np.uint64(0xFFFF)
        streams = np.array(list(self.plain), np.int64)
        held = np.zeros(len(streams), np.int64)
        every = np.concatenate(self.runs) if self.runs else np.zeros(0, np.uint64)
        pairs = (every & ~low) | np.repeat(np.arange(len(streams)), [len(x) for x in self.runs]).astype(np.uint64)
        bucket = (every & np.uint64(self.buckets - 1)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable") if self.buckets > 1 else slice(None)
        for b, part in enumerate(np.split(pairs[order], np.cumsum(np.bincount(bucket, minlength=self.buckets))[:-1])):
            part = np.unique(part)
            if len(part):
                page = (part & low).astype(np.int64)
                held += np.bincount(page, minlength=len(held))
                own, at = np.unique(page, return_inverse=True)
                run = part >> np.uint64(16)
                steps = np.diff(run, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6]
                yield b, streams[own].tobytes(), steps.T.tobytes() + at.astype(np.uint16).view(np.uint8).reshape(-1, 2).T.tobytes()
        yield -1, streams.tobytes(), held.astype(np.int32).tobytes() + np.array(list(self.plain.values()), np.uint8).tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(html, host, buckets) -> (host, bucket, streams, held), see :class:`_Chunk`."""
    chunks: dict[str, _Chunk] = {}
    names, total = ["host", "bucket", "streams", "held"], 0

    def sent(hosts: list[str]) -> Iterator[pa.RecordBatch]:
        for host in hosts:
            rows = list(chunks.pop(host).rows())
            for i in range(0, len(rows), 64):
                bucket, streams, held = zip(*rows[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(streams, pa.binary()), pa.array(held, pa.binary())], names)

    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            found = [_unmarked(x.as_py()) for x in part.column(0)]
            streams = [[w for _, text in page for w in text.split()] for page in found]
            for page, words, runs, host, buckets in zip(found, streams, run_hashes(streams, RUN), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                chunk = chunks.setdefault(host, _Chunk(buckets))
                name = stream_id(tuple(words))
                if name not in chunk.plain:
                    chunk.plain[name] = False
                    chunk.runs.append(runs.copy())
                    total += len(runs) + 16
                chunk.plain[name] |= any(region == "plain" for region, _ in page)
                if len(chunk.plain) == 1 << 16:
                    yield from sent([host])
            if total > HELD_RUNS:
                yield from sent(list(chunks))
                total = 0
    yield from sent(list(chunks))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`_signed` sent, by host and bucket -> (host, stream, run, n, plain): a row a stream without a run, and one for each run that several streams share."""
    groups: dict[tuple[str, int], list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for host, bucket, streams, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            groups.setdefault((host, bucket), []).append((streams, held))

    def rows(host: str, streams: np.ndarray, run: np.ndarray | None, n: np.ndarray | None = None, plain: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        k = len(streams)
        columns = [pa.array([host] * k, pa.string()), pa.array(streams, pa.int64()), pa.nulls(k, pa.int64()) if run is None else pa.array(run, pa.int64()),
                   pa.nulls(k, pa.int32()) if n is None else pa.array(n, pa.int32()), pa.nulls(k, pa.bool_()) if plain is None else pa.array(plain, pa.bool_())]
        yield from pa.Table.from_arrays(columns, ["host", "stream", "run", "n", "plain"]).to_batches(max_chunksize=1 << 16)

    for host, bucket in list(groups):
        streams, runs = [], []
        for named, held in groups.pop((host, bucket)):
            own = np.frombuffer(named, np.int64)
            if bucket < 0:
                yield from rows(host, own, None, np.frombuffer(held[: 4 * len(own)], np.int32), np.frombuffer(held[4 * len(own) :], np.uint8) > 0)
                continue
            n = len(held) // 8
            planes = np.frombuffer(held, np.uint8)
            steps = np.zeros((n, 8), np.uint8)
            steps[:, :6] = planes[: 6 * n].reshape(6, n).T
            at = np.ascontiguousarray(planes[6 * n :].reshape(2, n).T).view(np.uint16).ravel()
            runs.append(np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64))
            streams.append(own[at])
        if runs:
            run, stream = np.concatenate(runs), np.concatenate(streams)
            order = np.argsort(run, kind="stable")
            run, stream = run[order], stream[order]
            same = run[1:] == run[:-1]
            some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            run, stream = run[some], stream[some]
            order = np.lexsort((stream, run))
            run, stream = run[order], stream[order]
            first = np.concatenate([[True], (run[1:] != run[:-1]) | (stream[1:] != stream[:-1])])[: len(run)]
            run, stream = run[first], stream[first]
            same = run[1:] == run[:-1]
            some = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(run) else np.zeros(0, bool)
            yield from rows(host, stream[some], ((run[some] << np.uint64(16)) | np.uint64(bucket)).view(np.int64))


def _copies(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, stream, page): the streams that are near-copies of a page before, and the first such one.

    pairs: the runs that several streams share; sizes: runs of each stream.  As in :func:`different_pages`, a
    stream is a page unless it is a near-copy of a smaller one that is.  Near-copies share a run of
    those that the rest of either can't outweigh, the rarest first; so a stream
    that is the least of the undecided ones at all such runs of its own is a page, and only what
    meets it there is compared with it.  As streams are numbered by hashes, few rounds decide all.
    """
    key = ["host", "stream"]
    need = sizes.select(*key, F.ceil(COPY * F.col("n") - 0.01).cast("int").alias("need")).where("need > 0")
    likely = pairs.groupBy(*key).agg(F.count("*").alias("shared")).join(need, key).where("shared >= need").select(*key, "need")
    some = saved(pairs.join(likely, key), "copy-runs")
    often = some.groupBy("host", "run").agg(F.count("*").alias("often")).where("often > 1")
    runs = some.join(often, ["host", "run"]).groupBy(*key).agg(F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("often", "run"))).alias("r"))
    nodes = saved(runs.where("size(r) >= need").select(*key, "need", F.col("r.run").alias("runs")), "copy-pages")
    places = saved(nodes.select(*key, F.explode(F.expr("slice(runs, 1, size(runs) - need + 1)")).alias("run")), "copy-places")
    found, left, pages = [], nodes.select(*key), None
    while not left.isEmpty():
        met = places.join(left, key, "left_semi")
        least = met.groupBy("host", "run").agg(F.min("stream").alias("least"))
        later = met.join(least, ["host", "run"]).where("stream > least").select(*key).distinct()
        first = saved(left.join(later, key, "left_anti"), "copy-first")
        lead = places.join(first, key, "left_semi").withColumnRenamed("stream", "page")
        others = places.join(lead, ["host", "run"]).where("stream <> page").select(*key, "page").distinct()
        one = nodes.select(*key, F.col("need").alias("need1"), F.col("runs").alias("runs1"))
        other = nodes.select("host", F.col("stream").alias("page"), F.col("need").alias("need2"), F.col("runs").alias("runs2"))
        alike = others.join(one, key).join(other, ["host", "page"]).where(F.size(F.array_intersect("runs1", "runs2")) >= F.greatest("need1", "need2"))
        found.append(saved(alike.select(*key, "page"), "copies"))
        left = saved(left.join(first, key, "left_anti").join(found[-1].select(*key).distinct(), key, "left_anti"), "copy-left")
    if not found:
        return nodes.select(*key, F.col("stream").alias("page"))
    return functools.reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.min("page").alias("page"))


def _enough(rule: tuple[int, float]) -> Column:
    return F.greatest(F.lit(float(rule[0])), rule[1] * F.col("total"))


def _covered(begins: np.ndarray, depth: int, length: int) -> np.ndarray:
    """The tokens that runs cover which begin at these places."""
    edges = np.zeros(length + 1, np.int64)
    at = np.flatnonzero(begins)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + depth, -1)
    return np.cumsum(edges[:-1]) > 0


def _pages(table: pa.Table) -> tuple[list[list[tuple[str, tuple[str, ...]]]], list[list[str]]]:
    """Unmarked blocks of the pages as words, and their streams."""
    worded = [[(region, tuple(text.split())) for region, text in _unmarked(x)] for x in table.column("html").to_pylist()]
    return worded, [[w for _, words in page for w in words] for page in worded]


def _hits(key: tuple, table: pa.Table, runs: pa.Table) -> pa.Table:
    """Blocks and long runs of a group's pages in which each run is a candidate: (host, kind, name, stream)."""
    if not table.num_rows or not runs.num_rows:
        return pa.table({"host": pa.array([], pa.string()), "kind": pa.array([], pa.string()), "name": pa.array([], pa.int64()), "stream": pa.array([], pa.int64())})
    buckets, wanted = table.column("buckets")[0].as_py(), np.unique(runs.column("name").to_numpy().view(np.uint64))
    worded, streams = _pages(table)
    found: set[tuple[str, int, int]] = set()
    for page, words, short, long in zip(worded, streams, run_hashes(streams, RUN), run_hashes(streams, LONG), strict=True):
        held = np.isin(_named(short, buckets), wanted)
        before = np.concatenate([[0], np.cumsum(held)])
        name, at = stream_id(tuple(words)), 0
        if len(long):
            whole = before[LONG - RUN + 1 :] - before[: -(LONG - RUN + 1)] == LONG - RUN + 1
            found.update(("long", x, name) for x in long[whole].view(np.int64).tolist())
        for _, own in page:
            n = len(own) - RUN + 1
            if n > 0 and before[at + n] - before[at] == n:
                found.add(("block", stream_id(own), name))
            at += len(own)
    kind, names, of = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"host": pa.array([table.column("host")[0].as_py()] * len(kind), pa.string()), "kind": pa.array(kind, pa.string()), "name": pa.array(names, pa.int64()), "stream": pa.array(of, pa.int64())})


def _cleared(key: tuple, table: pa.Table, gone: pa.Table) -> pa.Table:
    """(page_id, url, text) of a group's pages without the boilerplate ``gone``, whose kind is short, long:region or block:region."""
    lists: dict[str, list[int]] = {}
    for kind, name in zip(gone.column("kind").to_pylist(), gone.column("name").to_pylist(), strict=True):
        lists.setdefault(kind, []).append(name)
    texts = []
    if table.num_rows:
        buckets = table.column("buckets")[0].as_py()
        runs = {kind: np.unique(np.array(names, np.int64)).view(np.uint64) for kind, names in lists.items() if not kind.startswith("block")}
        dropped = {kind: set(names) for kind, names in lists.items() if kind.startswith("block")}
        none = np.zeros(0, np.uint64)
        worded, streams = _pages(table)
        for page, words, short, long in zip(worded, streams, run_hashes(streams, RUN), run_hashes(streams, LONG), strict=True):
            everywhere = _covered(np.isin(_named(short, buckets), runs.get("short", none)), RUN, len(words))
            by_region = {region: _covered(np.isin(long, runs[f"long:{region}"]), LONG, len(words)) for region in LONG_RUNS if f"long:{region}" in runs}
            at, kept = 0, []
            for region, own in page:
                here = slice(at, at + len(own))
                at += len(own)
                if len(own) >= RUN and stream_id(own) in dropped.get(f"block:{region}", ()):
                    continue
                off = everywhere[here] | by_region[region][here] if region in by_region else everywhere[here]
                kept += [w for w, g in zip(own, off.tolist(), strict=True) if not g]
            texts.append(" ".join(kept))
    return table.select(["page_id", "url"]).append_column("text", pa.array(texts, pa.string()))


def _large(named: DataFrame, hosts: DataFrame, id_type: str, parts: int) -> DataFrame:
    """(page_id, url, text) of the pages of large hosts, each judged by its whole host.

    named: (page_id, url, html, host) of all pages; hosts: the large ones with their ``groups`` and ``buckets``.
    """
    pages = named.join(hosts, "host")
    signed = pages.select("html", "host", "buckets").mapInArrow(_signed, "host string, bucket int, streams binary, held binary")
    found = saved(signed.repartition(parts, "host", "bucket").mapInArrow(_neighbours, "host string, stream long, run long, n int, plain boolean"), "host-runs")
    sizes = found.where("run is null").groupBy("host", "stream").agg(F.max("n").alias("n"), F.max("plain").alias("plain"))
    pairs = found.where("run is not null").select("host", "stream", "run")
    copies = saved(_copies(pairs, sizes), "copies-of").where("page <> stream")

    def holders(rows: DataFrame, *what: str) -> DataFrame:
        """How many different pages of its host hold each of these."""
        page = F.coalesce("page", "stream")
        return rows.join(copies, ["host", "stream"], "left").groupBy("host", *what).agg(F.count_distinct(page).alias("holders")).join(totals, "host")

    one = copies.groupBy("host").agg(F.count("*").alias("less"))
    totals = saved(sizes.groupBy("host").agg(F.count("*").alias("all"), F.max("plain").alias("plain")).join(one, "host", "left")
                   .select("host", (F.col("all") - F.coalesce("less", F.lit(0))).alias("total"), "plain"), "host-pages")
    rules = [SHORT_RUNS, *BLOCKS.values(), *LONG_RUNS.values()]
    unless_plain = [SHORT_RUNS, *(rule for region, rule in BLOCKS.items() if region != "plain"), *(rule for region, rule in LONG_RUNS.items() if region != "plain")]
    least = F.when(F.col("plain"), F.least(*map(_enough, rules))).otherwise(F.least(*map(_enough, unless_plain)))
    likely = saved(holders(pairs, "run").where(F.col("holders") >= least).select("host", F.col("run").alias("name"), (F.col("holders") >= _enough(SHORT_RUNS)).alias("short")), "host-candidates")
    dealt = pages.withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("groups")))
    groups = hosts.select("host", F.explode(F.expr("sequence(0L, groups - 1)")).alias("part"))

    def judged(function, lists: DataFrame, schema: str) -> DataFrame:  # noqa: ANN001
        """Pages of the hosts that have lists, in groups, with their host's list."""
        some = dealt.join(lists.select("host").distinct(), "host", "left_semi").select("page_id", "url", "html", "host", "part", "buckets").repartition(parts, "host", "part")
        return some.groupBy("host", "part").cogroup(lists.join(groups, "host").groupBy("host", "part")).applyInArrow(function, schema)

    gone = likely.where("short").select("host", F.lit("short").alias("kind"), "name")
    if not likely.isEmpty():
        hits = saved(judged(_hits, likely.select("host", "name"), "host string, kind string, name long, stream long"), "host-hits")
        counted = saved(holders(hits.distinct(), "kind", "name"), "host-counts")
        for kind, by_region in (("long", LONG_RUNS), ("block", BLOCKS)):
            for region, rule in by_region.items():
                own = counted.where((F.col("kind") == kind) & (F.col("holders") >= _enough(rule)))
                gone = gone.unionByName(own.select("host", F.lit(f"{kind}:{region}").alias("kind"), "name"))
        gone = saved(gone, "host-boilerplate")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [" ".join(text for _, text in _unmarked(x.as_py())) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    schema = f"page_id {id_type}, url string, text string"
    if gone.isEmpty():
        return pages.select("page_id", "url", "html").mapInArrow(joined, schema)
    clean = pages.join(gone.select("host").distinct(), "host", "left_anti").select("page_id", "url", "html").mapInArrow(joined, schema)
    return clean.unionByName(judged(_cleared, gone, schema))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    html: whole page, null is empty; a page without main text gives the empty string.
    Pages without a host in their url form one host of their own; repeated rows are
    judged alike.  Page ids may be null.  An empty table gives no rows; other columns
    are not read.
    """
    spark = pages.sparkSession
    named = pages.select("page_id", "url", "html", F.coalesce(
        F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")).alias("host"))
    # written, so that its size is known and the pages themselves needn't be shuffled for a small table
    count = F.count("*")
    large = saved(named.groupBy("host").agg(
        F.ceil(count / PAGES).alias("groups"),
        F.pow(F.lit(2), F.greatest(F.lit(0), F.least(F.lit(16), F.ceil(F.log2(count / BUCKET_PAGES))))).cast("int").alias("buckets")).filter("groups > 1"), "large-hosts")
    dealt = named.join(large, "host", "left_anti")
    id_type = dict(pages.dtypes)["page_id"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [blocks(x.as_py() or "") for x in part.column(2)]
                regions = pa.array([[r for r, _ in b] for b in found], pa.list_(pa.string()))
                texts = pa.array([[t for _, t in b] for b in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), regions, texts], ["page_id", "url", "host", "regions", "texts"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            rows_of: dict[str, list[int]] = {}
            for i, key in enumerate(batch.column(2).to_pylist()):
                rows_of.setdefault(key, []).append(i)
            for key, rows in rows_of.items():
                groups.setdefault(key, []).append(batch.take(pa.array(rows)))
        for key in list(groups):
            rows = pa.Table.from_batches(groups.pop(key)).combine_chunks()
            given = [list(zip(r, t, strict=True)) for r, t in zip(rows.column("regions").to_pylist(), rows.column("texts").to_pylist(), strict=True)]
            out = rows.select(["page_id", "url"]).append_column("text", pa.array(main_texts(given), pa.string()))
            yield from out.to_batches(max_chunksize=512)

    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = partitions(spark, 2 * size if size < 1 << 60 else 0, PARTITION_BYTES)
    parsed = dealt.select("page_id", "url", "html", "host").mapInArrow(
        parse, f"page_id {id_type}, url string, host string, regions array<string>, texts array<string>")
    found = parsed.repartition(parts, "host").mapInArrow(extract, f"page_id {id_type}, url string, text string")
    if not large.isEmpty():
        found = found.unionByName(_large(named, large, id_type, parts))
    return found.withColumn("n_chars", F.length("text").cast("long"))
