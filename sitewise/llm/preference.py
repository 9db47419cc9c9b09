"""Preference formatting: a chosen and a rejected conversation as one prompt and two completions.

The longest common prefix of turns is rendered once, as the prompt; what follows on
either side is rendered as a completion in segments, each with a flag that says whether
it is trained on: what an assistant says, with its end mark.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _segments(turns: Column) -> Column:
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(_head(t).alias("text"), F.lit(False).alias("train")),
        F.struct(F.concat(t["text"], F.lit(END)).alias("text"), (t["role"] == "assistant").alias("train")))))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns (role, text) of each conversation in order of ``turn``.

    Null roles and texts are empty; rows without a conv_id belong to no conversation.
    Null turn numbers come first; ties go by role, then text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.collect_list(turn).alias("all"))
    return grouped.select("conv_id", F.transform(F.array_sort("all"), lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def stale_pairs(talks: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) of (conv_id, turns).

    chosen is the conversation up to its last assistant turn; rejected has the reply
    before that one in its place, or an empty reply if there is none.  A conversation
    without an assistant turn has no pair.
    """
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    numbers = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0))
    found = talks.select("conv_id", "turns", said.alias("said"), F.array_max(numbers).alias("last")).filter("last > 0")
    stale = F.when(F.size("said") > 1, F.element_at("said", -2)["text"]).otherwise(F.lit(""))
    return found.select(
        "conv_id", F.slice("turns", F.lit(1), F.col("last")).alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array(F.struct(F.lit("assistant").alias("role"), stale.alias("text")))).alias("rejected"))


def formatted(pairs: DataFrame) -> DataFrame:
    """Replace chosen and rejected by n_shared, prompt, and two arrays of segments (text, train).

    chosen, rejected: arrays of (role, text), null being empty.  Equal conversations are
    all prompt with empty completions.  Other columns stay; an empty table gives no rows.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    clean = {c: F.transform(F.coalesce(c, none), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
             for c in ("chosen", "rejected")}
    given = pairs.withColumns(clean)
    differs = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b)), False).cast("int")
    counted = given.withColumn("n_shared", F.when(differs > 0, differs - 1).otherwise(F.size("chosen")))
    rest = {c: _segments(F.slice(F.col(c), F.col("n_shared") + 1, F.size(c))) for c in ("chosen", "rejected")}
    return counted.withColumns({"prompt": _rendered(F.slice("chosen", F.lit(1), F.col("n_shared"))), **rest})


def digests(done: DataFrame) -> DataFrame:
    """Counts and digests of :func:`formatted`'s rows; a mask lists each segment's length and flag."""
    def text(c: str) -> Column:
        return F.sha2(F.array_join(F.transform(c, lambda s: s["text"]), "").cast("binary"), 256)

    def mask(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat(F.length(s["text"]).cast("string"), F.when(s["train"], "+").otherwise("-"))), "")

    return done.select(
        "conv_id", F.col("n_shared").cast("long").alias("n_shared"), F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"),
        text("chosen").alias("chosen_sha256"), mask("chosen").alias("chosen_mask"), text("rejected").alias("rejected_sha256"), mask("rejected").alias("rejected_mask"))


ORACLE = r"""
WITH t AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
             ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
a AS (SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS said FROM t),
p AS (SELECT conv_id, turns[1:said[-1]] AS chosen,
        list_append(turns[1:said[-1] - 1], struct_pack(role := 'assistant', text := CASE WHEN len(said) > 1 THEN turns[said[-2]].text ELSE '' END)) AS rejected
      FROM a WHERE len(said) > 0),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, len(chosen) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1, len(chosen)) AS n_shared FROM p),
s AS (SELECT conv_id, n_shared,
        list_aggregate(list_transform(chosen[1:n_shared], lambda x: '<|' || x.role || E'|>\n' || x.text || E'<|end|>\n'), 'string_agg', '') AS prompt,
        chosen[n_shared + 1:] AS c, rejected[n_shared + 1:] AS r FROM n)
SELECT conv_id, CAST(n_shared AS BIGINT) AS n_shared, sha256(coalesce(prompt, '')) AS prompt_sha256,
  sha256(coalesce(list_aggregate(list_transform(c, lambda x: '<|' || x.role || E'|>\n' || x.text || E'<|end|>\n'), 'string_agg', ''), '')) AS chosen_sha256,
  coalesce(list_aggregate(list_transform(c, lambda x: (length(x.role) + 5) || '-' || (length(x.text) + 8) || CASE WHEN x.role = 'assistant' THEN '+' ELSE '-' END), 'string_agg', ''), '') AS chosen_mask,
  sha256(coalesce(list_aggregate(list_transform(r, lambda x: '<|' || x.role || E'|>\n' || x.text || E'<|end|>\n'), 'string_agg', ''), '')) AS rejected_sha256,
  coalesce(list_aggregate(list_transform(r, lambda x: (length(x.role) + 5) || '-' || (length(x.text) + 8) || CASE WHEN x.role = 'assistant' THEN '+' ELSE '-' END), 'string_agg', ''), '') AS rejected_mask
FROM s
"""
