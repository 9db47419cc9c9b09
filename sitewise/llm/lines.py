"""Line dedup: content-defined chunks of lines that occur more than once.

A chunk ends after a line whose rolling hash, over its own hash and those of the lines
just before, is divisible by ``every``; so chunk borders move with the text and don't
depend on where a passage stands.  Chunks with at least two non-blank lines that occur
elsewhere earlier are removed.  Chunks are grouped by hash and bytes, and a chunk is cut
from a document only if its bytes equal those of the group.

DataFrame functions only.  Barriers (``inline`` of one struct) keep an array from being
computed again for each of its elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import whole_row

EVERY = 4   # lines of a chunk on average
WINDOW = 2  # lines that the rolling hash covers


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a barrier that the optimizer doesn't move expressions across."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _shifted(array: Column, by: int, fill: Column) -> Column:
    return F.slice(F.concat(F.array_repeat(fill, by), array), F.lit(1), F.size(array))


def _with_chunks(docs: DataFrame) -> DataFrame:
    """Add ``lines`` and ``ends``: the number of the last line of each chunk, from 1."""
    lined = _fixed(docs, lines=F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1))
    hashed = _fixed(lined, hashes=F.transform("lines", lambda x: F.xxhash64(x)))
    rolling = F.transform("hashes", lambda x: x)
    for k in range(1, WINDOW):
        rolling = F.zip_with(rolling, _shifted(F.col("hashes"), k, F.lit(0).cast("long")), lambda a, b: F.xxhash64(a, b))
    last = F.size("lines") - 1
    ends = F.filter(F.transform(rolling, lambda x, i: F.when((F.pmod(x, F.lit(EVERY)) == 0) | (i == last), i + 1).otherwise(0)), lambda x: x > 0)
    return _fixed(hashed, ends=ends).drop("hashes")


def _body(first: Column, last: Column) -> Column:
    return F.array_join(F.slice("lines", first, last - first + 1), "\n")


def _chunks(docs: DataFrame) -> DataFrame:
    """(doc, mark, first, last, body) of every chunk with two non-blank lines or more."""
    cut = _with_chunks(docs)
    firsts = _shifted(F.transform("ends", lambda x: x + 1), 1, F.lit(1))
    pairs = F.filter(F.zip_with(firsts, "ends", lambda a, b: F.struct(a.alias("first"), b.alias("last"))), lambda p: p["last"] > p["first"])
    shown = F.size(F.filter(F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1), lambda x: F.trim(x) != "")) > 1
    rows = cut.select("doc", "mark", "lines", F.inline(pairs)).filter(shown)
    return rows.select("doc", "mark", "first", "last", _body(F.col("first"), F.col("last")).alias("body"))


def _repeated(docs: DataFrame) -> DataFrame:
    """(doc, mark, gone): per text, its chunks (first, last, body) that came earlier already."""
    chunks = _chunks(docs).withColumn("hash", F.xxhash64("body"))
    groups = chunks.groupBy("hash", "body").agg(F.count("*").alias("n"), F.min("doc").alias("least")).filter("n > 1").drop("n")
    places = chunks.select("doc", "mark", "first", "last", "hash")
    found = places.join(groups, "hash").select("doc", "mark", F.struct("hash", "body", "first", "last", "least").alias("c"))
    per_text = found.groupBy("doc", "mark").agg(F.collect_set("c").alias("cs"))
    held = _fixed(per_text, sorted=F.array_sort("cs"))
    before = _shifted(F.col("sorted"), 1, F.lit(None).cast(dict(held.dtypes)["sorted"][len("array<") : -1]))
    again = F.zip_with("sorted", before, lambda x, p: F.when(
        F.coalesce(x["least"] < F.col("doc"), x["least"].isNotNull()) | F.coalesce((p["hash"] == x["hash"]) & (p["body"] == x["body"]), F.lit(False)),
        F.struct(x["first"].alias("first"), x["last"].alias("last"), x["body"].alias("body"))))
    return held.select("doc", "mark", F.array_sort(F.filter(again, lambda x: x.isNotNull())).alias("gone"))


def judged(docs: DataFrame) -> DataFrame:
    """(row: all columns of docs, kept, n_lines, n_removed), one row per input row.

    Lines are parted by newlines; a null text is one empty line.  The first occurrence of
    a chunk, by doc_id and place, stays; a null doc_id comes after all others, and null
    ones don't remove from each other.  Rows with equal doc_id and text are judged alike.
    Kept lines are joined by newlines.  An empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("mark"), whole_row(docs))
    gone = _repeated(keyed.select("doc", "mark", F.struct(F.col("row.text").alias("text")).alias("row")))
    same = F.col("l.doc").eqNullSafe(F.col("r.doc")) & (F.col("l.mark") == F.col("r.mark"))
    joined = keyed.alias("l").join(gone.alias("r"), same, "left").select("l.row", "r.gone")
    lined = _fixed(joined, lines=F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1))
    # a chunk stays unless these lines have the very bytes of its group; a span of another text cannot slip in
    true = F.filter(F.coalesce("gone", F.array().cast(dict(joined.dtypes)["gone"])), lambda g: _body(g["first"], g["last"]) == g["body"])
    cut = _fixed(lined, spans=F.transform(true, lambda g: F.struct(g["first"].alias("first"), g["last"].alias("last"))))
    left = F.concat(F.array(F.lit(1)), F.transform("spans", lambda s: s["last"] + 1))
    right = F.concat(F.transform("spans", lambda s: s["first"] - 1), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(left, right, lambda a, b: F.slice("lines", a, F.greatest(b - a + 1, F.lit(0)))))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return cut.select("row", F.array_join(kept, "\n").alias("kept"), F.size("lines").cast("long").alias("n_lines"), removed.alias("n_removed"))


def without_repeated_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``; documents left without a line go.

    All columns of the input return, n_chars (if there) counting the new text.
    """
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    left = judged(docs).filter("n_removed = 0 or n_removed < n_lines")
    return left.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
