"""Preference formatting, in DataFrame functions only.

A pair is two conversations: chosen and rejected. Their longest common prefix of turns is rendered once, as the prompt;
the turns after it are rendered as the two completions. A completion's mask tells which of its characters count for the
loss: those of assistant turns' texts and end marks, not the headers and not the turns of others. It is written as run
lengths, two for each turn: characters that don't count, then characters that do.

Each side is gathered by pair once, turns in order: one row is one training example, and everything after that is one
pass over its turns. Pairs are independent, so a conversation or first turn that many pairs share is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(df: DataFrame, name: str) -> DataFrame:
    turn = F.struct(F.coalesce("turn", F.lit(-1).cast("long")).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.where("pair_id IS NOT NULL").groupBy("pair_id").agg(F.sort_array(F.collect_list(turn)).alias(name))


def _render(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE))), "")


def _mask(turns):
    head = lambda t: F.length(t["role"]) + len(OPEN) + len(AFTER_ROLE)
    body = lambda t: F.length(t["text"]) + len(CLOSE)
    runs = lambda t: F.when(t["role"] == "assistant", F.concat_ws(",", head(t), body(t))).otherwise(F.concat_ws(",", head(t) + body(t), F.lit(0)))
    return F.array_join(F.transform(turns, runs), ",")


def _formatted(both: DataFrame) -> DataFrame:
    """Pairs (pair_id, c, r) of ordered turns to the result."""
    differs = F.filter(F.sequence(F.lit(0), F.greatest(F.size("c"), F.size("r"))), lambda i: ~F.get("c", i)["role"].eqNullSafe(F.get("r", i)["role"]) | ~F.get("c", i)["text"].eqNullSafe(F.get("r", i)["text"]) | (i >= F.least(F.size("c"), F.size("r"))))
    both = both.withColumn("k", F.array_min(differs))
    rest = lambda name: F.slice(name, F.col("k") + 1, F.greatest(F.size(name) - F.col("k"), F.lit(0)))
    both = both.withColumns({"p": F.slice("c", F.lit(1), F.col("k")), "cc": rest("c"), "rr": rest("r")})
    return both.select("pair_id", F.col("k").cast("long").alias("prompt_turns"), _render(F.col("p")).alias("prompt"), _render(F.col("cc")).alias("chosen"), _mask(F.col("cc")).alias("chosen_mask"), _render(F.col("rr")).alias("rejected"), _mask(F.col("rr")).alias("rejected_mask"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask) of each pair_id on both sides.

    Both inputs: pair_id, turn, role, text; other columns are ignored. Turns go by turn, then role, then text; repeated
    rows are turns of their own. Null roles and texts are empty, null turn numbers are -1, rows with a null pair_id are
    left out, as are pairs with one side only. Equal sides give a prompt and two empty completions; with no common turn
    the prompt is empty. Empty tables give no rows.
    """
    return _formatted(_turns(chosen, "c").join(_turns(rejected, "r"), "pair_id"))


def format_branches(conversations: DataFrame) -> DataFrame:
    """format_preferences' columns for pairs made from a table without preferences: (conv_id, turn, role, text).

    Chosen is each conversation; rejected is the same up to turn conv_id modulo its turns, then its neighbour's turns
    from that place on (ids 2 i and 2 i + 1 are neighbours). A conversation without a neighbour is paired with itself:
    all of it is prompt. Every conversation gives one row but those with a null id; nulls and ties as there.
    """
    turns = _turns(conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"), "c")
    other = turns.select(F.expr("pair_id ^ 1").alias("pair_id"), F.col("c").alias("o"))
    both = turns.join(other, "pair_id", "left").withColumn("at", F.pmod("pair_id", F.size("c")).cast("int"))
    branch = F.concat(F.slice("c", F.lit(1), F.col("at")), F.slice("o", F.col("at") + 1, F.greatest(F.size("o") - F.col("at"), F.lit(0))))
    return _formatted(both.select("pair_id", "c", F.coalesce(branch, "c").alias("r")))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against the one that goes on as its neighbour from some turn."""
    return format_branches(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = f"""
WITH c AS (SELECT conv_id AS pair_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY pair_id) AS n FROM c),
z AS (SELECT DISTINCT pair_id, (pair_id % n + n) % n AS pos FROM o),
r AS (SELECT o.pair_id, o.role, o.text, o.i FROM o JOIN z USING (pair_id) LEFT JOIN z y ON y.pair_id = xor(z.pair_id, 1) WHERE o.i <= z.pos OR y.pair_id IS NULL
      UNION ALL SELECT z.pair_id, o.role, o.text, o.i FROM z JOIN o ON o.pair_id = xor(z.pair_id, 1) WHERE o.i > z.pos),
n AS (SELECT 'c' AS side, pair_id, role, text, i FROM o UNION ALL SELECT 'r', * FROM r),
k AS (SELECT a.pair_id, count(*) AS turns, min(CASE WHEN b.i IS NULL OR a.role <> b.role OR a.text <> b.text THEN a.i END) AS first
      FROM n a LEFT JOIN n b ON b.side = 'r' AND b.pair_id = a.pair_id AND b.i = a.i WHERE a.side = 'c' GROUP BY a.pair_id),
t AS (SELECT n.*, coalesce(k.first, k.turns + 1) - 1 AS k, '{OPEN}' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM n JOIN k USING (pair_id)),
g AS (SELECT pair_id, side, max(k) AS k, coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE i <= k), '') AS prompt, coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE i > k), '') AS rest,
      coalesce(string_agg(CASE WHEN role = 'assistant' THEN length(head) || ',' || length(body) ELSE (length(head) + length(body)) || ',0' END, ',' ORDER BY i) FILTER (WHERE i > k), '') AS mask FROM t GROUP BY pair_id, side)
SELECT a.pair_id, a.k::BIGINT AS prompt_turns, a.prompt, a.rest AS chosen, a.mask AS chosen_mask, coalesce(b.rest, '') AS rejected, coalesce(b.mask, '') AS rejected_mask
FROM g a LEFT JOIN g b ON b.side = 'r' AND a.pair_id = b.pair_id WHERE a.side = 'c'
"""
