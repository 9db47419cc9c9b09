"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sitewise.llm import bpe_codec, exact, html_text, lines, nearest, packing, preference, simhash, substring, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
# every name that an operator uses inside, as a column of the caller, one with a dot
CLASH = "row mark doc spans lines gone hash score fp item unit seq label kept a.b"
PASSAGE = " ".join(f"w{i}" for i in range(60))
LINES = "\n".join(f"line {i}" for i in range(40))
LONG = " ".join(f"v{i % 997} x{i % 1009}" for i in range(60_000))
TEXTS = [(1, PASSAGE), (2, "new " + PASSAGE + " end"), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (6, "one"), (7, LONG), (8, LONG), (None, PASSAGE), (None, "no id here"),
         (9, LINES), (10, "zero\n" + LINES), (11, "you idiot"), (12, "Ünï çödé <|endoftext|> 中文 \x1c x")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("mine") for c in CLASH.split()})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_bpe(docs, none):
    codec = Tokenizer.from_file(PATH)
    got = sorted(bpe_codec.encode_decode(docs, PATH).collect(), key=str)
    assert len(got) == len(TEXTS) and bpe_codec.encode_decode(none, PATH).count() == 0
    for doc, text in TEXTS:
        ids = codec.encode(text or "", add_special_tokens=False).ids
        want = (doc, np.array(ids, "<u4").tobytes(), codec.decode(ids, skip_special_tokens=False))
        assert any((r.doc_id, bytes(r.ids), r.decoded) == want for r in got)


def test_substring(docs, none):
    got = [(r.doc_id, r.text, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect()]
    assert len(got) == len(TEXTS) and substring.remove_repeats(none).count() == 0
    by = {(d, t): (n, m, k) for d, t, n, m, k in got}
    assert by[1, PASSAGE] == (60, 0, PASSAGE) and by[2, TEXTS[1][1]] == (62, 60, "new end")
    assert by[None, PASSAGE] == (60, 60, "") and by[None, "no id here"][1] == 0
    assert by[3, None] == (0, 0, "") and by[5, " \t\n"] == (0, 0, "") and by[7, LONG][1] == 0 and by[8, LONG][1] == 120_000
    left = substring.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(TEXTS) - 2
    assert left.filter("doc_id = 2").first().n_chars == len("new end") and left.filter("doc_id = 5").first().text == " \t\n"


def test_packing(docs, none):
    got = packing.pack(docs, PATH, 2048).toPandas()
    assert packing.pack(none, PATH, 2048).count() == 0
    full = got.sort_values(["sequence_id", "offset"])
    assert (full.groupby("sequence_id").length.cumsum() - full.length == full.offset).all() and full.groupby("sequence_id").length.sum().max() <= 2048
    sizes = [len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS]
    assert got.length.sum() == sum(sizes) and len(got) == sum(-(-n // 2048) for n in sizes)
    assert got.sequence_id.nunique() == -(-sum(sizes) // 2048)


def test_many_small_pieces_take_few_sequences(spark):
    items = spark.range(20_000).select(F.col("id").alias("item"), (F.col("id") % 37 + 1).alias("length"))
    got = packing.best_fit(spark, items, 2048).join(items, "item").toPandas()
    assert len(got) == 20_000 and got.sequence_id.nunique() == -(-int(got.length.sum()) // 2048)


def test_lines(docs, none):
    got = {(r.row.doc_id, r.row.text): r for r in lines.judged(docs).collect()}
    assert lines.judged(docs).count() == len(TEXTS) and lines.judged(none).count() == 0
    assert got[9, TEXTS[11][1]].n_removed == 0 and got[10, TEXTS[12][1]].n_removed >= 20
    assert got[10, TEXTS[12][1]].kept.startswith("zero") and got[3, None].n_lines == 1
    left = lines.without_repeated_chunks(docs)
    assert left.columns == docs.columns and left.filter("doc_id = 1").first().text == PASSAGE
    nulls = docs.filter("doc_id = 9").select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert [r.n_removed for r in lines.judged(nulls.unionByName(nulls)).collect()] == [0, 0]


def test_exact(spark, docs, none, tmp_path):
    docs.write.parquet(f"{tmp_path}/d")
    none.write.parquet(f"{tmp_path}/e")
    assert exact.duplicates(spark, f"{tmp_path}/e").count() == 0
    for weak in (exact.sha256, lambda t: F.substring(exact.sha256(t), 1, 1)):  # the second one makes different texts meet
        got = exact.duplicates(spark, f"{tmp_path}/d", weak).collect()
        assert len(got) == len(TEXTS)
        kept = sorted(r.doc_id for r in got if r.kept and r.doc_id is not None)
        assert kept == [1, 2, 3, 5, 6, 7, 9, 10, 11, 12]
        empty = [r for r in got if r.doc_id in (3, 4)]
        assert {r.keep_id for r in empty} == {3} and {r.group_size for r in empty} == {2}
        assert sorted((r.kept, r.keep_id) for r in got if r.doc_id is None) == [(False, 1), (True, None)]
        assert [r.text_sha256 for r in got if r.doc_id == 5] == [hashlib.sha256(b" ").hexdigest()]


def test_toxicity(spark, docs, none):
    rows = [(i, "such an idiot you are" if i % 5 == 0 else f"calm words number {i}", int(i % 5 == 0)) for i in range(200)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    got = {(r.row.doc_id, r.row.text): r.score for r in toxicity.scored(docs, model).collect()}
    assert toxicity.scored(docs, model).count() == len(TEXTS) and toxicity.scored(none, model).count() == 0
    assert got[11, "you idiot"] > max(v for k, v in got.items() if k[0] != 11) and got[3, None] == got[4, ""] and all(0 <= v <= 1 for v in got.values())
    assert toxicity.train(spark.createDataFrame(rows[1:3], "doc_id long, text string, label int")).intercept < -5  # one label only
    assert toxicity.train(spark.createDataFrame([], "doc_id long, text string, label int")).intercept == 0


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) and simhash.near_duplicates(none).count() == 0
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert {c for (d, f), c in by.items() if f == 0} == {3} and all(f == 0 for d, f in by if d in (3, 4, 5))
    assert {c for (d, _), c in by.items() if d in (7, 8)} == {7}
    kept = simhash.one_per_component(docs, simhash.near_duplicates(docs))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(6) == 1 and ids.count(None) == 2 and 8 not in ids


def test_nearest(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 0.0]), (8, []), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "q": F.lit(1), "rank": F.lit(0)})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, 3).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 2, 1.0)]
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 3).count() == 0


def test_html(spark):
    pages = [(1, "http://h/a", "<nav>menu</nav><article><h1>T&amp;t</h1><p>a<b>b</b> c<br>d<p>e<script>x</script></article><footer>f</footer>"), (2, None, None), (3, "h", ""),
             (4, "http://h/b", "plain &lt;text&gt;<div class='sidebar x'>no</div><!-- no --> more"), (4, "http://h/b", "plain &lt;text&gt;<div class='sidebar x'>no</div><!-- no --> more"),
             (5, "http://h/c", "<article>cut off &am"), (None, "http://h/d", "<p>unclosed <b>bold" + " long" * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "part": F.lit("y"), "text": F.lit("z")})
    got = sorted((r.page_id or 0, r.text[:40], r.n_chars == len(r.text)) for r in html_text.main_text(df).collect())
    assert got == [(0, ("unclosed bold" + " long" * 9)[:40], True), (1, "T&t ab c d e", True), (2, "", True), (3, "", True), (4, "plain <text> more", True), (4, "plain <text> more", True), (5, "cut off &am", True)]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_html_shared_runs_go(spark):
    pages = [(i, f"http://h/{i}", f"<div>please accept our terms before you read on</div><p>{' '.join(f'u{i}x{k}' for k in range(20))}</p>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert all(r.text == " ".join(f"u{r.page_id}x{k}" for k in range(20)) for r in html_text.main_text(df).collect())


def test_preference(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", "hey"), (1, 3, "assistant", "bye"), (1, 2, "user", "and"), (2, 0, "user", "only"), (3, 0, "assistant", None), (3, 0, None, "x"),
            (None, 0, "assistant", "lost"), (4, 0, "user", "q"), (4, 1, "assistant", "same"), (4, 2, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"turns": F.lit(0), "chosen": F.lit(0)})
    done = preference.formatted(preference.stale_pairs(preference.conversations(df)))
    got = {r.conv_id: r for r in done.collect()}
    assert sorted(got) == [1, 3, 4] and preference.conversations(df.limit(0)).count() == 0
    assert got[1].n_shared == 3 and got[1].prompt == "<|user|>\nhey<|end|>\n<|assistant|>\nhi<|end|>\n<|user|>\nand<|end|>\n"
    assert [tuple(s) for s in got[1].chosen] == [("<|assistant|>\n", False), ("bye<|end|>\n", True)] and got[1].rejected[1].text == "hi<|end|>\n"
    assert got[4].n_shared == 3 and got[4].chosen == [] and got[4].rejected == []


def test_pipeline_stages_on_odd_tables(spark, docs, none):
    sf = "/root/testdata/sf0.001"
    for table in (docs, none):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, now = now, stage(spark, now, sf)
            assert now.columns == table.columns, name
            assert now.count() <= before.count()
        last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert last.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_the_rest_of_a_packing_takes_no_more_rounds(spark, monkeypatch):
    rounds, sweep = [], packing._sweep
    monkeypatch.setattr(packing, "_sweep", lambda *a: rounds.append(1) or sweep(*a))
    items = spark.range(60).selectExpr("id * 3 + 1 as item", "id * id % 97 + if(id % 7 = 0, 900, 1) as length")
    packed = {}
    for limit in (20_000, 40):
        monkeypatch.setattr(packing, "FINISH_ROWS", limit)
        rounds.clear()
        got = packing.best_fit(spark, items, 1000).join(items, "item").toPandas().sort_values(["sequence_id", "offset"])
        packed[limit] = (len(rounds), got["sequence_id"].nunique())
        assert sorted(got["item"]) == [3 * i + 1 for i in range(60)]
        assert (got["offset"] == got.groupby("sequence_id")["length"].cumsum() - got["length"]).all()
        assert (got.groupby("sequence_id")["length"].sum() <= 1000).all()
    assert packed[20_000] == (0, 12) and packed[40][0] > 0
