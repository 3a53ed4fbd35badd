"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The longest common prefix of turns (equal role and text) is rendered once as the prompt; the
rest of either side is its completion. A completion's mask lists the code-point ranges that
the assistant wrote, the only ones to train on.

A conversation is one record here, as a document is elsewhere: its turns meet in one row
because the result is one rendered row. DataFrame functions only.

Defined results: null roles and texts count as empty; turns with equal numbers are ordered by
role, then text; rows with a null conversation id are left out, as they belong to none; a
conversation without an assistant turn has equal sides, so two empty completions; other
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "\n<|end|>\n"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """start-end of each assistant text in the rendered turns, comma-joined."""
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + (len(OPEN) + len(CLOSE) + len(END))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + len(OPEN) + F.length(t["role"]) + len(CLOSE)
        span = F.concat_ws("-", begin.cast("string"), (begin + F.length(t["text"])).cast("string"))
        return F.struct((acc["at"] + size(t)).alias("at"), F.when(t["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def preference_rows(pairs: DataFrame) -> DataFrame:
    """``pairs(conv_id, chosen, rejected)``, both sides arrays of (role, text), to conv_id,
    n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, usable."""
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.transform(F.slice("chosen", F.lit(1), shorter), lambda t, i: t.eqNullSafe(F.get("rejected", i)))
    differs = F.array_position(same, False)
    n = F.when(differs > 0, differs - 1).otherwise(shorter).cast("int")
    cut = pairs.withColumn("_n", n)
    rest = lambda side: F.slice(side, F.col("_n") + 1, F.size(side))
    out = cut.select(
        "conv_id",
        F.col("_n").cast("bigint").alias("n_prompt_turns"),
        _rendered(F.slice("chosen", F.lit(1), F.col("_n"))).alias("prompt"),
        _rendered(rest("chosen")).alias("chosen"),
        _rendered(rest("rejected")).alias("rejected"),
        _mask(rest("chosen")).alias("chosen_mask"),
        _mask(rest("rejected")).alias("rejected_mask"),
    )
    return out.withColumn("usable", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != ""))


def swapped_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs of single conversations: chosen is the conversation as it is, rejected
    has the last assistant text of its neighbour (conv_id with the lowest bit flipped; without
    one, an empty text) in place of its own."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    last = F.array_max(F.transform("_turns", lambda t, i: F.when(t["role"] == "assistant", i).otherwise(-1)))
    whole = whole.withColumn("_last", last)
    reply = whole.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.when(F.col("_last") >= 0, F.get("_turns", F.col("_last"))["text"]).alias("_reply"))
    plain = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    return whole.join(reply, "conv_id", "left").select(
        "conv_id",
        F.transform("_turns", plain).alias("chosen"),
        F.transform("_turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("_last"), F.coalesce("_reply", F.lit(""))).otherwise(t["text"]).alias("text"))).alias("rejected"),
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(i) AS i FROM t WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT xor(conv_id, 1) AS conv_id, text FROM t JOIN last USING (conv_id, i)),
s AS (SELECT t.conv_id, t.i, t.role, t.text AS c, CASE WHEN last.i IS NULL THEN t.text ELSE coalesce(reply.text, '') END AS r
  FROM t LEFT JOIN last ON t.conv_id = last.conv_id AND t.i = last.i LEFT JOIN reply ON t.conv_id = reply.conv_id),
n AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE c <> r), count(*)) AS n FROM s GROUP BY conv_id),
m AS (SELECT s.*, n.n, '<|' || role || '|>' || chr(10) || c || chr(10) || '<|end|>' || chr(10) AS cr, '<|' || role || '|>' || chr(10) || r || chr(10) || '<|end|>' || chr(10) AS rr FROM s JOIN n USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(cr)) FILTER (WHERE i >= n) OVER w, 0) + 5 + length(role) AS ca, coalesce(sum(length(rr)) FILTER (WHERE i >= n) OVER w, 0) + 5 + length(role) AS ra FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, any_value(n) AS n_prompt_turns, coalesce(string_agg(cr, '' ORDER BY i) FILTER (WHERE i < n), '') AS prompt,
  coalesce(string_agg(cr, '' ORDER BY i) FILTER (WHERE i >= n), '') AS chosen, coalesce(string_agg(rr, '' ORDER BY i) FILTER (WHERE i >= n), '') AS rejected,
  coalesce(string_agg(CAST(ca AS VARCHAR) || '-' || CAST(ca + length(c) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i >= n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(ra AS VARCHAR) || '-' || CAST(ra + length(r) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i >= n AND role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (WHERE i >= n AND role = 'assistant') > 0 AS usable
FROM o GROUP BY conv_id
"""
