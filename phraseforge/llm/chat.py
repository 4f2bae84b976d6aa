"""Chat formatting by cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again and again as it grows. A rolling hash of each turn prefix tells which logged
conversations are prefixes of longer ones; anti-joins leave the maximal ones, and only these are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """turns with i (place from 1), h1 and h2 (128 bits of the prefix up to here) and n (turns of the conversation).

    Each turn's hash holds its place, so the running exclusive or stands for the sequence. One shuffle, by conv_id."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("i_turn").eqNullSafe(F.col("turn")) & F.col("i_role").eqNullSafe(F.col("role")) & F.col("i_text").eqNullSafe(F.col("text")) & F.col("i_any").isNotNull()
    turns = turns.withColumns({"i_any": F.lag(F.lit(1)).over(order), "i_turn": F.lag("turn").over(order), "i_role": F.lag("role").over(order), "i_text": F.lag("text").over(order)})
    turns = turns.where(~same).drop("i_any", "i_turn", "i_role", "i_text").withColumn("i", F.row_number().over(order))
    said = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    for k in (1, 2):
        turns = turns.withColumn(f"t{k}", F.xxhash64(F.lit(k), "i", *said))
    return turns.withColumns({**{f"h{k}": F.expr(f"bit_xor(t{k})").over(sofar) for k in (1, 2)}, "n": F.count(F.lit(1)).over(Window.partitionBy("conv_id"))}).drop("t1", "t2")


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id of the conversations that are a prefix of no longer one; of equal ones the smallest id.

    Both sides of the anti-join are made distinct by partial aggregation first: a first turn that a third of all
    conversations share is one row."""
    whole = hashed.where("i = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    shorter = hashed.where("i < n").select(F.col("i").alias("n"), "h1", "h2").distinct()
    return whole.join(shorter, ["n", "h1", "h2"], "left_anti").select("conv_id")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Render the maximal conversations: conv_id, n_turns, rendered.

    Each turn is `<|role|>`, a line break, the text, and a line break, by turn, then role, then text (nulls first). Null role or text
    is as empty, in comparing too. A row that repeats another of its conversation whole counts once. Rows without conv_id
    belong to no conversation and are left out. Other columns are not read. An empty table gives no rows."""
    turns = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null")
    hashed = prefix_hashes(turns)
    kept = hashed.join(maximal(hashed), "conv_id", "left_semi")
    lines = F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("line"))))
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered"))


SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM d),
p AS (SELECT conv_id, i, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg(concat(length(r), ':', r, length(x), ':', x), '') OVER (PARTITION BY conv_id ORDER BY i) AS said FROM t),
whole AS (SELECT n, said, min(conv_id) AS conv_id FROM p WHERE i = n GROUP BY n, said),
kept AS (SELECT conv_id FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i < p.n AND p.i = whole.n AND p.said = whole.said))
SELECT conv_id, count(*) AS n_turns, string_agg(concat('<|', r, '|>', chr(10), x, chr(10)), '' ORDER BY i) AS rendered
FROM t WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id
"""
