"""Preference pairs of conversations as one prompt and two masked completions; DataFrame functions only.

The longest common prefix of turns (same role, same text) of the chosen and the rejected conversation
is rendered once, as prompt. What follows on either side is rendered as its completion, with a mask:
the spans of characters, "begin-end" and apart by blanks, that the assistant wrote and training counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
TURN = "struct<role:string,text:string>"


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """The spans of the assistant's turns, each with its closing line end, in the rendered turns."""
    sizes = lambda t: (F.length(_head(t)), F.length(t["text"]) + 1)

    def step(so_far: Column, t: Column) -> Column:
        head, body = sizes(t)
        begin = so_far["at"] + head
        span = F.concat_ws("-", begin.cast("string"), (begin + body).cast("string"))
        return F.struct((begin + body).alias("at"), F.when(t["role"] == ASSISTANT, F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, step)["spans"], " ")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns two conversations share from their start."""
    pairs = F.zip_with(chosen, rejected, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differ = F.array_position(pairs, False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(pairs)).cast("int")


def turns_of(turns: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per key with its turns in order. Turns without a key belong to nothing; NULL roles and texts are empty.

    Rows that repeat a turn's number follow by role and text. A conversation is one value, as is what is
    rendered from it.
    """
    say = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("own"), say.alias("say"))
    grouped = rows.groupBy("own").agg(F.sort_array(F.collect_list("say")).alias("said"))
    return grouped.select(F.col("own").alias(key), F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_pairs(pairs: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """key, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask of pairs of arrays of turns.

    Equal conversations are all prompt, with empty completions. A NULL conversation has no turns. Every
    row is formatted, repeated keys too; other columns are ignored.
    """
    none = F.array().cast(f"array<{TURN}>")
    both = pairs.select(F.col(f"`{key}`").alias("own"), F.coalesce(F.col(chosen), none).alias("c"), F.coalesce(F.col(rejected), none).alias("r")).withColumn("n", common_turns(F.col("c"), F.col("r")))
    after = lambda a: F.slice(a, F.col("n") + 1, F.greatest(F.size(a) - F.col("n"), F.lit(0)))
    parts = both.select("own", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), after(F.col("c")).alias("c"), after(F.col("r")).alias("r"))
    return parts.select(
        F.col("own").alias(key), F.col("n").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"),
        render(F.col("r")).alias("rejected"), mask(F.col("c")).alias("chosen_mask"), mask(F.col("r")).alias("rejected_mask"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """As format_pairs(), of two tables of turns (key, turn, role, text); a key that one lacks has no turns there."""
    side = lambda turns, name: turns_of(turns, key).toDF("own", name)
    return format_pairs(side(chosen, "chosen").join(side(rejected, "rejected"), "own", "full_outer"), "own").withColumnRenamed("own", key)


def last_reply_pairs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """A pair for each conversation with a reply: chosen ends with its last reply, rejected with the reply before (or an empty one) in its place.

    A stale reply is a plausible worse answer, so that recorded conversations give pairs by themselves.
    What follows the last reply is left out; conversations without a reply give no pair.
    """
    whole = turns_of(turns, key).toDF("own", "turns")
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == ASSISTANT, i + 1)), lambda i: i.isNotNull())
    told = whole.withColumn("replies", replies).filter(F.size("replies") > 0).withColumn("last", F.element_at("replies", -1))
    before = F.when(F.size("replies") > 1, F.element_at("turns", F.element_at("replies", -2))["text"]).otherwise(F.lit(""))
    stale = F.array(F.struct(F.lit(ASSISTANT).alias("role"), before.alias("text")))
    head = F.slice("turns", F.lit(1), F.col("last") - 1)
    return told.select(F.col("own").alias(key), F.slice("turns", F.lit(1), F.col("last")).alias("chosen"), F.concat(head, stale).alias("rejected"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, i, text, lag(text) OVER (PARTITION BY conv_id ORDER BY i) AS stale, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM t WHERE role = 'assistant'),
last AS (SELECT conv_id, i AS last, coalesce(stale, '') AS stale FROM a WHERE k = 1),
s AS (SELECT conv_id, i, role, text AS c, CASE WHEN i = last THEN stale ELSE text END AS r, last FROM t JOIN last USING (conv_id) WHERE i <= last),
n AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE c <> r) - 1, max(last)) AS n FROM s GROUP BY 1),
d AS (SELECT *, '<|' || role || '|>' || chr(10) AS head FROM s JOIN n USING (conv_id)),
o AS (SELECT *, sum(length(head || c) + 1) OVER w - length(c) - 1 AS cb, sum(length(head || r) + 1) OVER w - length(r) - 1 AS rb
  FROM d WHERE i > n WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
p AS (SELECT conv_id, max(n) AS n, coalesce(string_agg(head || c || chr(10), '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt,
  coalesce(string_agg(head || c || chr(10), '' ORDER BY i) FILTER (WHERE i > n), '') AS chosen,
  coalesce(string_agg(head || r || chr(10), '' ORDER BY i) FILTER (WHERE i > n), '') AS rejected FROM d GROUP BY 1),
m AS (SELECT conv_id, string_agg(cb || '-' || (cb + length(c) + 1), ' ' ORDER BY i) AS cm, string_agg(rb || '-' || (rb + length(r) + 1), ' ' ORDER BY i) AS rm FROM o WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, CAST(n AS INTEGER) AS n_prompt_turns, prompt, chosen, rejected, coalesce(cm, '') AS chosen_mask, coalesce(rm, '') AS rejected_mask FROM p LEFT JOIN m USING (conv_id)
"""
