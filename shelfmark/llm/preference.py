"""Preference pairs: the longest common turn prefix once as prompt, then both completions with their masks.

The input is a long table of turns (pair, side, turn, role, text).  One aggregation by the whole turn finds
which turns both sides have; the first turn number at which they differ, one number per pair, splits prompt
from completions.  Conversations are never gathered into one row or task, so a pair may hold any share of
all turns.  A result row is one rendered turn of ``prompt``, ``chosen`` or ``rejected``; concatenated by
(turn, role, text) they are the prompt and its two completions.  ``trained`` masks what the loss covers:
assistant turns of the completions.

Defined cases: turns are matched by their number, and a number that only one side has ends the prefix;
equal rows count once; several rows at one number are compared as a set; a null turn number sorts last and
never belongs to the prefix; a null role is ``unknown``, a null text empty; a row with a null pair id forms
the pair null; a pair with one side only has an empty prompt; markers inside a text are broken up by a
zero-width space, so that no text can open or close a turn; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import table

TRAINED_ROLES = ("assistant",)


def rendered(role, text):
    """One turn in the chat template."""
    plain = lambda c: F.replace(F.replace(c, F.lit("<|"), F.lit("<​|")), F.lit("|>"), F.lit("|​>"))
    return F.concat(F.lit("<|"), plain(role), F.lit("|>\n"), plain(text), F.lit("<|end|>\n"))


def format_preferences(turns: DataFrame, pair: str = "pair", side: str = "side", trained=TRAINED_ROLES) -> DataFrame:
    """Rows (pair, part, turn, role, rendered, trained) of all pairs; ``side`` is ``chosen`` or ``rejected``."""
    rows = turns.select(
        F.col(pair).alias("pair"),
        F.col("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.col(side) == "chosen").alias("chosen"),
    )
    merged = rows.groupBy("pair", "turn", "role", "text").agg(
        F.max("chosen").alias("in_chosen"), F.max(~F.col("chosen")).alias("in_rejected")
    )
    alone = (rows.groupBy("pair", "turn", "role", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))
             .agg(F.max("chosen").alias("c"), F.max(~F.col("chosen")).alias("r")).where(~(F.col("c") & F.col("r"))))
    split = alone.groupBy(F.col("pair").alias("of")).agg(F.min("turn").alias("split"), F.lit(True).alias("differs"))
    joined = merged.join(split, F.col("pair").eqNullSafe(F.col("of")), "left")
    common = F.col("turn").isNotNull() & (F.col("differs").isNull() | F.col("split").isNull() | (F.col("turn") < F.col("split")))
    part = F.when(common, F.array(F.lit("prompt"))).otherwise(
        F.filter(F.array(F.when(F.col("in_chosen"), "chosen"), F.when(F.col("in_rejected"), "rejected")), lambda x: x.isNotNull())
    )
    return joined.select("pair", F.explode(part).alias("part"), "turn", "role", "text").select(
        "pair", "part", "turn", "role",
        rendered(F.col("role"), F.col("text")).alias("rendered"),
        ((F.col("part") != "prompt") & F.col("role").isin(*trained)).alias("trained"),
    )


def op1_preference(spark, sf_dir):
    """Pairs made of the whole table: a conversation is preferred to the mixture that keeps its first turns
    (0 to 3 of them, by its id) and goes on with those of its neighbour (id with the last bit turned)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    neighbour = F.expr("conv_id ^ 1")
    kept = lambda c: (c % 7) % 4
    sides = F.array(
        F.struct(F.col("conv_id").alias("pair"), F.lit("chosen").alias("side")),
        F.when(F.col("turn") < kept(F.col("conv_id")), F.struct(F.col("conv_id").alias("pair"), F.lit("rejected").alias("side"))),
        F.when(F.col("turn") >= kept(neighbour), F.struct(neighbour.alias("pair"), F.lit("rejected").alias("side"))),
    )
    paired = turns.select("*", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("s")).select(
        "s.pair", "s.side", "turn", "role", "text"
    )
    return format_preferences(paired)


_PLAIN = "replace(replace({0}, '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>')"
ORACLE = f"""
WITH sides AS (
  SELECT conv_id AS pair, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM conversations WHERE turn < conv_id % 7 % 4
  UNION ALL SELECT xor(conv_id, 1), 'rejected', turn, role, text FROM conversations WHERE turn >= xor(conv_id, 1) % 7 % 4),
merged AS (
  SELECT pair, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         bool_or(side = 'chosen') AS c, bool_or(side = 'rejected') AS r
  FROM sides GROUP BY ALL),
split AS (SELECT pair, min(turn) FILTER (NOT (c AND r)) AS split FROM merged GROUP BY pair),
parts AS (
  SELECT m.*, m.turn < coalesce(split, m.turn + 1) AS common FROM merged m JOIN split USING (pair)),
out AS (
  SELECT pair, 'prompt' AS part, turn, role, text FROM parts WHERE common
  UNION ALL SELECT pair, 'chosen', turn, role, text FROM parts WHERE NOT common AND c
  UNION ALL SELECT pair, 'rejected', turn, role, text FROM parts WHERE NOT common AND r)
SELECT pair, part, turn, role,
       '<|' || {_PLAIN.format('role')} || '|>' || chr(10) || {_PLAIN.format('text')} || '<|end|>' || chr(10) AS rendered,
       part <> 'prompt' AND role = 'assistant' AS trained
FROM out
"""
