"""Operator 5: preference formatting.

A pair is two conversations, chosen and rejected.  The longest common prefix of their turns is rendered once as the
prompt; what follows on each side is its completion, with the spans of assistant text that count for the loss (the
rest is masked).  Turns are compared by place, so no conversation is gathered before its rendered row.

A null role or text counts as empty.  Turns without a number come first.  Turns that share a number stand in order of
role and text.  A pair with one side
only has an empty prompt; two equal sides give an all-prompt pair with empty completions.  Pairs with a null id are
one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID


def _opening(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _spans(turns: Column) -> Column:
    """'start-end' of each assistant text in the rendered turns, in characters."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_opening(t["role"]))
        end = start + F.length(t["text"])
        span = F.concat(F.when(acc["out"] == "", F.lit("")).otherwise(F.lit(",")), start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, begin, add, lambda acc: acc["out"])


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t["role"]), t["text"], F.lit("\n"))), "")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns (pair_id, side, turn, role, text), side 'chosen' or 'rejected' -> pair_id, prompt, chosen, rejected,
    chosen_loss, rejected_loss ('start-end,...' character spans of the completion), n_prompt_turns."""
    t = turns.select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text"))
    t = t.withColumn("at", place)
    one = lambda side: F.max(F.when(F.col("side") == side, F.struct("role", "text"))).alias(side)
    both = t.groupBy("pair_id", "at").agg(one("chosen"), one("rejected"))
    differs = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    row = both.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(differs, F.col("at"))), F.max("at") + 1).alias("split"),
        F.sort_array(F.collect_list(F.struct("at", "chosen", "rejected"))).alias("all"),
    )

    def part(side: str, after: bool) -> Column:
        keep = lambda x: (x["at"] >= F.col("split") if after else x["at"] < F.col("split")) & x[side].isNotNull()
        return F.transform(F.filter("all", keep), lambda x: x[side])

    return row.select(
        "pair_id",
        _rendered(part("chosen", False)).alias("prompt"),
        _rendered(part("chosen", True)).alias("chosen"),
        _rendered(part("rejected", True)).alias("rejected"),
        _spans(part("chosen", True)).alias("chosen_loss"),
        _spans(part("rejected", True)).alias("rejected_loss"),
        (F.col("split") - 1).cast("long").alias("n_prompt_turns"),
    )


def stale_answer_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of one pair per conversation.

    chosen: the conversation up to its last assistant turn.  rejected: the same, with that last answer replaced by the
    conversation's first answer, or by an empty one where they are the same turn.  Without an assistant turn both
    sides are the whole conversation.
    """
    c = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(NULL_ID)).alias("turn"), "role", "text")
    mine = Window.partitionBy("conv_id")
    answer = F.when(F.col("role") == "assistant", F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))
    c = c.withColumn("last", F.max(answer).over(mine)).withColumn("first", F.min(answer).over(mine))
    c = c.where(F.col("last").isNull() | (F.col("turn") <= F.col("last.turn")))
    stale = F.when(F.col("first.turn") == F.col("last.turn"), F.lit("")).otherwise(F.col("first.text"))
    is_last = (F.col("role") == "assistant") & (F.col("turn") == F.col("last.turn"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), F.when(is_last, stale).otherwise(F.col("text")).alias("text")))
    return c.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")


def op5_preference_format(spark, sf_dir: str) -> DataFrame:
    return preference_pairs(stale_answer_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP5_SQL = """
WITH turns AS (SELECT conv_id, coalesce(turn, -9223372036854775808) AS turn, role, text FROM conversations),
ends AS (
  SELECT conv_id, turn, role, text,
    max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_turn,
    min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS first_turn
  FROM turns),
first_answer AS (SELECT conv_id, min(coalesce(text, '')) AS answer FROM ends WHERE turn = first_turn AND role = 'assistant' GROUP BY conv_id),
kept AS (SELECT e.*, f.answer FROM ends e LEFT JOIN first_answer f ON f.conv_id IS NOT DISTINCT FROM e.conv_id WHERE last_turn IS NULL OR turn <= last_turn),
sided AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS chosen,
    CASE WHEN role = 'assistant' AND turn = last_turn THEN CASE WHEN first_turn = last_turn THEN '' ELSE answer END
      ELSE coalesce(text, '') END AS rejected
  FROM kept),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, chosen) AS pos FROM sided),
cut AS (
  SELECT *, coalesce(min(CASE WHEN chosen <> rejected THEN pos END) OVER (PARTITION BY conv_id),
    max(pos) OVER (PARTITION BY conv_id) + 1) AS split FROM placed),
pieces AS (
  SELECT *, '<|' || role || '|>' || chr(10) || chosen || chr(10) AS c, '<|' || role || '|>' || chr(10) || rejected || chr(10) AS r,
    length(role) + 5 AS opening FROM cut),
ends2 AS (
  SELECT *, sum(CASE WHEN pos >= split THEN length(c) ELSE 0 END) OVER w AS c_end,
    sum(CASE WHEN pos >= split THEN length(r) ELSE 0 END) OVER w AS r_end
  FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id AS pair_id,
  coalesce(string_agg(c, '' ORDER BY pos) FILTER (pos < split), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY pos) FILTER (pos >= split), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY pos) FILTER (pos >= split), '') AS rejected,
  coalesce(string_agg((c_end - length(c) + opening)::VARCHAR || '-' || (c_end - 1)::VARCHAR, ',' ORDER BY pos)
    FILTER (pos >= split AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg((r_end - length(r) + opening)::VARCHAR || '-' || (r_end - 1)::VARCHAR, ',' ORDER BY pos)
    FILTER (pos >= split AND role = 'assistant'), '') AS rejected_loss,
  CAST(max(split) - 1 AS BIGINT) AS n_prompt_turns
FROM ends2 GROUP BY conv_id
"""
