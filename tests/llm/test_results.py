"""Whole queries against plain versions, libraries, SQL or held-out labels."""

import hashlib
import tracemalloc
import html
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from . import brute

import corpus_pipeline
from sitewise.llm import catalog, html_text, packing, simhash, substring, toxicity
from sitewise.llm.bpe import Encoder

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


PIECES = st.sampled_from(["the", "Ing", "'s", "'LL", "a", "Σ", "É", "é", "İ", "中", "½", "7", "😀", ".", "...", " ", "\n", "\x1c", "\x85", " ", "‍", "<|endoftext|>", "<|", "ﬁ"])


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.lists(PIECES, max_size=12).map("".join), st.text(max_size=20)), max_size=4))
def test_encoder_equals_the_library(tokenizer, encoder, texts):
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = list(encoder.encode(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [encoder.decode(x) for x in got] == [tokenizer.decode(x, skip_special_tokens=False) for x in want]


def test_op1(spark, docs):
    want = {d: (len(w), len(w) - len(k), sha(" ".join(k))) for d, (w, k) in brute.substring(docs).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in catalog.op1_substring_dedup(spark, SMALL).collect()} == want


def test_op1_strings_cut_anywhere(spark, monkeypatch):
    """Small k, repeats inside and across documents, runs cut into many strings."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "b", "cc"], rng.integers(0, 60))) for _ in range(60)]
    docs = list(enumerate(texts))
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.kept.split() for r in substring.remove_repeats(rows, 9).collect()}
    assert got == {d: k for d, (_, k) in brute.substring(docs, 9).items()}


def test_op2_and_op4(spark, docs, tokenizer):
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in docs}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in catalog.op2_bpe(spark, SMALL).collect()}
    assert got == {d: (len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), sha(tokenizer.decode(i, skip_special_tokens=False))) for d, i in ids.items()}
    pieces = catalog.op4_packing(spark, SMALL).toPandas()
    for d, i in ids.items():
        full = np.array([*i, 0], "<u4")
        own = pieces[pieces.doc_id == d].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(full), 2048)) and own.length.sum() == len(full)
        assert [zlib.crc32(full[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    check_packing(pieces)


def check_packing(pieces):
    placed = pieces.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 2048
    assert placed.sequence_id.nunique() <= 1.01 * -(-placed.length.sum() // 2048) + 1


def test_op3(spark):
    rows = pq.read_table(f"{MORE}/embeddings.parquet").to_pylist()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = catalog.op3_nearest(spark, MORE).toPandas().sort_values(["query_id", "rank"])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[q]
        score[q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        own = got[got.query_id == ids[q]]
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, [vectors[ids == v][0] @ vectors[q] for v in own.vec_id], rtol=0, atol=1e-12)
        hits += len(set(ids[best]) & set(own.vec_id))
        total += 20
    assert hits / total >= 0.9


@pytest.mark.parametrize("name", ["op5_preference", "op7_exact_dedup"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{MORE}/{t}.parquet')")
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, MORE)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_op6(spark, docs):
    want = {d: (n, m, sha(t)) for d, (n, m, t) in brute.lines(docs).items()}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in catalog.op6_line_dedup(spark, SMALL).collect()} == want


def test_op8(spark):
    got = catalog.op8_toxicity(spark, MORE).toPandas()
    labels = spark.read.parquet(f"{MORE}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{MORE}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    held = got.merge(labels, on="doc_id").query("held_out")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert clean.predicted.mean() < 0.05 and toxic.predicted.mean() > 0.6


def test_op9(spark, docs):
    want = brute.groups(docs)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in catalog.op9_simhash(spark, SMALL).collect()} == want


def test_op9_dense_fingerprints(spark, monkeypatch):
    """Many fingerprints in each other's reach, worked off in several passes."""
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, 6, np.uint64)
    flips = lambda: np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    fps = np.unique([c ^ flips() for c in centres for _ in range(60)])
    parent = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            a, b = parent[i], parent[j]
            parent = [min(a, b) if p in (a, b) else p for p in parent]
    buckets = simhash.Buckets(6, 2)
    root = np.arange(len(fps))
    for limit in (1 << 22, 1 << 12):
        monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", limit)
        sent = [(b, np.frombuffer(x, np.uint64)) for b, x in zip(*buckets.send(fps), strict=True)]
        links = [buckets.links(int(b), x, 4) for b, x in sent]
        a, b = (np.searchsorted(fps, np.concatenate(x)) for x in zip(*links, strict=True))
        root = simhash._joined(np.arange(len(fps)), a, b)
        assert [int(x) for x in root] == parent


def test_op10(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in catalog.op10_html_text(spark, MORE).collect()}
    for p in pq.read_table(f"{MORE}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", p["html"] or "", re.S)
        text = " ".join(html.unescape(re.sub(r"</?[ab]>", "", re.sub(r"</?(?:p|h1|br)>", " ", article[1] if article else ""))).split())
        assert got[p["page_id"]] == (text, len(text))


def test_blocks_of_odd_markup():
    assert html_text.blocks("a<b>b</b>c<br>d") == [("plain", "abc"), ("plain", "d")]
    assert html_text.blocks("<main><p>x<p>y<aside>no<p>no</aside>z</main>w") == [("main", "x"), ("main", "y"), ("marked", "no"), ("marked", "no"), ("main", "z"), ("plain", "w")]
    assert html_text.blocks('<article><div class="post-comments">no</div>yes<script>if (a<b) "</p>"</script></article>') == [("marked", "no"), ("main", "yes")]
    assert html_text.blocks("1 < 2 &lt; 3 <!-- x --> <a title='>'>t</a>") == [("plain", "1 < 2 < 3 t")]


@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'>", "<div class='no-sidebar'>", "<body class='page-with-nav'><div id=page-with-nav>", "<form action=/>", "<div class=widget>", "<div role=form>"])
def test_wrappers_of_an_article_are_no_chrome(wrapper):
    page = f"{wrapper}<div class=ad>buy it</div><nav>menu</nav><article><p>real text</p><p class=notice>more of it</p><div class='related share widget'>and more</div><div class=ad>no</div></article>"
    assert [t for r, t in html_text.blocks(page) if r == "main"] == ["real text", "more of it", "and more"]
    assert {t: r for r, t in html_text.blocks(page)}["buy it"] == {t: r for r, t in html_text.blocks(page)}["menu"] == "marked"
    page = f"{wrapper}<nav>menu</nav><div class=ad>buy</div><p>text of a page without an article</p><div class=comments>said</div>"
    assert html_text.blocks(page) == [("marked", "menu"), ("marked", "buy"), ("plain", "text of a page without an article"), ("marked", "said")]


@pytest.mark.parametrize("bar", ["nav", "aside", "footer", "div class=comments", "div class='nav-primary'", "div role=navigation"])
def test_articles_in_chrome_are_none(bar):
    assert html_text.blocks(f"<main>yes</main><{bar}><article>no</article></{bar.split()[0]}>") == [("main", "yes"), ("marked", "no")]


def test_shared_runs():
    streams = [["s"] * 3 + list("abcdefgh"), list("zabcdefg"), list("qrstuvwx")]
    assert [x.tolist() for x in html_text.shared_by(streams, 6)] == [[1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 1], [1, 2, 2, 2, 2, 2, 2, 2], [1] * 8]


def test_word_hashes_take_little_memory(monkeypatch):
    texts = [" ".join(f"w{(i * 7919 + t) % 5000}" for i in range(20_000)).encode() for t in range(40)] + [b"", b"one"]
    size = sum(map(len, texts))
    tracemalloc.start()
    words = substring.Words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * size + 45 * substring.SLICE_BYTES
    monkeypatch.setattr(substring, "SLICE_BYTES", 1 << 30)  # all at once gives the same hashes
    assert (substring.Words(texts).hash == words.hash).all()
    monkeypatch.setattr(substring, "SLICE_BYTES", 3)  # and so do pieces of a word each
    assert (substring.Words(texts[:1]).hash == words.hash[:20_000]).all()


@pytest.mark.parametrize("length", [9, 30, 45, 49])
def test_hot_minimisers_are_split(spark, monkeypatch, length):
    monkeypatch.setattr(substring, "HOT_BYTES", 8000)
    line = " ".join(f"line{i}" for i in range(length))
    docs = [(d, " ".join([*(f"a{d}x{i}" for i in range(60)), line, *(f"b{d}x{i}" for i in range(60))])) for d in range(80)]
    docs += [(100 + d, docs[d][1]) for d in (0, 7)] + [(200, docs[3][1][200:] + " tail")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hot = substring.hot_minimisers(df.selectExpr("doc_id as doc", "0L as mark", "text"), 50)
    words = substring.Words([t.encode() for _, t in docs])

    def most(hot):
        heads, counts, least, level = substring.super_kmers(words, 50, hot)
        size = {}
        for h, n, key in zip(heads.tolist(), counts.tolist(), zip(least.tolist(), level.tolist(), strict=True), strict=True):
            size.setdefault(key, set()).add(words.slice(h, n + 49))
        return max(sum(map(len, x)) for x in size.values())

    assert most([]) > 8000 >= most(hot)
    got = {r.doc_id: r.kept.split() for r in substring.remove_repeats(df).collect()}
    assert got == {d: kept for d, (_, kept) in brute.substring(docs).items()}


def unique(page, n=60):
    return " ".join(f"u{page}x{k}" for k in range(n))


def test_short_phrases_of_plain_pages_stay():
    pages = [[("plain", f"{unique(i)} as the old saying has it here {unique(-i - 1)}" if i in (3, 5) else unique(i))] for i in range(12)]
    assert html_text.main_texts(pages) == [p[0][1] for p in pages]


def test_copies_are_one_page():
    text = unique("copied", 200)
    near = text.replace("ucopiedx100 ", "another ")
    copies = [[("plain", f"advert of page {i} with eight tokens"), ("plain", near if i % 2 else text)] for i in range(10)]
    assert html_text.main_texts(copies) == [" ".join(t for _, t in p) for p in copies]  # a host without articles that mirrors one text
    for region in ("plain", "main"):
        mirror = [[("marked", f"advert {i}"), (region, text)] for i in range(30)] + [[(region, unique(i))] for i in range(3)]
        assert html_text.main_texts(mirror) == [p[-1][1] for p in mirror]
        assert html_text.main_texts([[(region, text)], [(region, near)]]) == [text, near]


def test_unclassed_notices_go():
    notice, terms = "sign up here for our weekly letter", "all rights reserved " + unique("terms", 40)
    pages = [[("main", unique(i)), ("main", notice if i % 2 else unique(f"{i}b")), ("main", unique(f"{i}c")), ("plain", terms if i % 4 == 0 else unique(f"{i}d"))] for i in range(40)]
    assert html_text.main_texts(pages) == [" ".join(t for _, t in p if t not in (notice, terms)) for p in pages]
    inside = [[("plain", f"{unique(i)} {terms} {unique(f'{i}e')}")] for i in range(8)]  # a long run within blocks
    assert html_text.main_texts(inside) == [f"{unique(i)} {unique(f'{i}e')}" for i in range(8)]


def test_pipeline(spark, docs):
    """Each stage against its plain version, on what the stage before kept."""
    from sitewise.llm.store import saved

    stages = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    now = saved(stages["toxicity"](spark, table, SMALL), "test")
    kept = {r.doc_id: r.text for r in now.collect()}
    toxic = {r.doc_id for r in catalog.op8_toxicity(spark, SMALL).collect() if r.predicted}
    assert kept == {d: t for d, t in docs if d not in toxic}
    for name, plain in (
        ("line_dedup", lambda ds: {d: t for d, (n, m, t) in brute.lines(ds).items() if m < n or not m}),
        ("simhash_near_dedup", lambda ds: {d: dict(ds)[d] for d, (_, c) in brute.groups(ds).items() if c == d}),
        ("substring_dedup", lambda ds: {d: " ".join(k) if len(k) < len(w) else dict(ds)[d] for d, (w, k) in brute.substring(ds).items() if k or not w}),
    ):
        want = plain(list(kept.items()))
        now = saved(stages[name](spark, now, SMALL), "test")
        rows = now.collect()
        kept = {r.doc_id: r.text for r in rows}
        assert now.columns == table.columns and kept == want and all(r.n_chars == len(r.text) for r in rows), name
    pieces = stages["packing"](spark, now, SMALL).toPandas()
    assert set(pieces.doc_id) == set(kept)
    check_packing(pieces)
    assert packing.pack(now, PATH).count() == len(pieces)


def plain_ngrams(text):
    """Hashed character n-grams by their definition: 3 to 6 letters, inside one word but for the ends."""
    padded = " " + (text or "").lower() + " "
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if all(c.isalnum() for c in gram[1:-1]):
                codes = [ord(c) + 1 if c.isalnum() else 1 for c in gram]
                total = sum(c * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, c in enumerate(codes)) % (1 << 64)
                mixed = (total ^ n) * 0xD6E8FEB86659FD93 % (1 << 64)
                mixed = (mixed ^ (mixed >> 32)) * 0xD6E8FEB86659FD93 % (1 << 64)
                out.add(mixed >> (64 - toxicity.BITS))
    return out


@pytest.mark.parametrize("kept", [toxicity.FEATURES, 50])
def test_toxicity_counts_ratios_and_scores_by_their_definition(spark, docs, kept):
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    rows = [(d, t[:3000], label[d]) for d, t in docs if label.get(d) in (0, 1)] + [(-1, "Ünï çödé 中文 x1", 1), (-2, None, 0), (-3, "", 0)]
    grams = {d: plain_ngrams(t) for d, t, _ in rows}
    sample = spark.createDataFrame([(y, t or "") for _, t, y in rows], "label int, text string")
    counts = {r["feature"]: (r["toxic"], r["clean"]) for r in toxicity._counts(sample).collect()}
    sizes = [sum(y == k for _, _, y in rows) for k in (0, 1)]
    want = {}
    for d, _, y in rows:
        for g in grams[d]:
            want.setdefault(g, [0, 0])[1 - y] += 1
    assert counts == {g: tuple(c) for g, c in want.items()}

    def share(n, k):
        return (n + toxicity.SMOOTH) / (sizes[k] + 2 * toxicity.SMOOTH)

    ratio = {g: math.log(share(t, 1) / share(c, 0)) for g, (t, c) in want.items() if t + c >= toxicity.LEAST_ROWS}
    worth = {g: (share(want[g][0], 1) - share(want[g][1], 0)) * r for g, r in ratio.items()}
    best = sorted(worth, key=lambda g: (-round(worth[g], 12), g))[:kept]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"), kept)
    assert len(model.index) == len(best) and {round(worth[g], 9) for g in model.index} == {round(worth[g], 9) for g in best}
    weight = dict(zip(model.index.tolist(), model.weight, strict=True))
    # scaled features: the coefficient is what is left of a weight after its ratio, and informative ones keep their sign
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    for d in grams:
        assert got[d] == pytest.approx(1 / (1 + math.exp(-sum(weight.get(g, 0.0) for g in grams[d]) - model.intercept)), abs=1e-9)


def test_a_large_host_is_judged_as_a_whole(spark, monkeypatch):
    """Many tasks give what one would, also where a group of pages alone would judge otherwise."""
    monkeypatch.setattr(html_text, "PAGES", 20)
    monkeypatch.setattr(html_text, "BUCKET_PAGES", 30, raising=False)
    terms, notice, quote, foot = "all rights reserved " + unique("terms", 40), "sign up here for our weekly letter", "as one of our readers put it last year", "you read this on our site today"

    def page(i):
        text = unique(i)
        if i % 10 == 7:  # copies and near-copies of three texts
            text = unique(f"copied{i % 3}").replace(f"ucopied{i % 3}x{i % 30} ", f"another{i % 20} ")
        out = [f"<p>{foot if i % 8 else unique(f'{i}f', 7)} {text}</p>"]
        out += [f"<p>{unique(f'{i}a')} {terms} {unique(f'{i}b')}</p>"] * (i % 9 == 4) + [f"<div>{notice}</div>"] * (i % 9 in (1, 2)) + [f"<p>{quote}</p>"] * (i in (3, 40))
        if i % 2:
            out = ["<article>", *out, "</article>"]
        return "<nav>menu</nav>" + "".join(out)

    rows = [(i, f"http://{'big' if i < 200 else 'small'}.net/{i}", page(i)) for i in range(215)] + [(None, "http://big.net/", None), (7, "http://big.net/7", page(7)), (500, "http://big.net/e", "<p>few words</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or -1, r.url), r.text) for r in html_text.main_text(df).collect())
    want = []
    for host in ("big", "small"):
        own = [r for r in rows if f"//{host}." in r[1]]
        want += [((r[0] or -1, r[1]), text) for r, text in zip(own, html_text.main_texts([html_text.blocks(r[2] or "") for r in own]), strict=True)]
    assert got == sorted(want)
    big = {i: text for (i, url), text in got if "//big." in url}
    assert not any(foot in text for text in big.values()) and sum(quote in text for text in big.values()) == 2
    assert all((terms in text) == (i % 9 == 4 and i % 2 == 1) and (notice in text) == (i % 9 in (1, 2) and i % 2 == 1) for i, text in big.items())  # in an article more pages must share it
    assert sum(f"ucopied{k}x0 " in text for text in big.values() for k in range(3)) == 20
