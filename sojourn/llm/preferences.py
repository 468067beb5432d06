"""Preference pairs for chat training: one prompt, two masked completions.

A chosen and a rejected conversation with the same pair id are compared turn by turn; the
turns before the first difference are the prompt, rendered once, and the rest of either
side is its completion. A result row is one rendered turn: reading a pair's rows by part
and turn gives the prompt, the chosen and the rejected text. ``train`` is true for the
assistant's turns of a completion, the only ones a loss may count.

All of it is joins and aggregates on (pair, turn), so a conversation may have any number
of turns. Defined results. Turns are placed by number; one that only one side has is a
difference. Rows that repeat a (pair, turn) are one turn, that of smallest role and text,
nulls last. Rows with a null pair or turn number cannot be placed and are left out. A null
text is rendered empty, a null role as "unknown". A pair of equal conversations has a
prompt only; a pair that one side lacks has no prompt. Extra columns never matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.operators.work import settle


def rendered(role: Column, text: Column) -> Column:
    """One turn; a marker inside a text is broken up so that it cannot pass for one."""
    inner = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), inner, F.lit("<|end|>\n"))


def turns(rows: DataFrame, side: str, pair: str = "pair", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per (pair, turn) with a struct named ``side``."""
    best = F.min(F.struct(F.col(role).isNull(), F.col(role).alias("role"), F.col(text).isNull(), F.col(text).alias("text")))
    named = rows.where(F.col(pair).isNotNull() & F.col(turn).isNotNull()).groupBy(F.col(pair).alias("pair"), F.col(turn).alias("turn")).agg(best.alias("b"))
    return named.select("pair", "turn", F.struct(F.coalesce("b.role", F.lit("unknown")).alias("role"), F.col("b.text").alias("text")).alias(side))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair, part (prompt, chosen, rejected), turn, role, rendered, train; inputs have pair, turn, role, text."""
    both = turns(chosen, "chosen").join(turns(rejected, "rejected"), ["pair", "turn"], "full")
    differs = F.col("chosen").isNull() | F.col("rejected").isNull() | ~F.col("chosen").eqNullSafe(F.col("rejected"))
    both = settle(both.withColumn("differs", differs))
    first = both.where("differs").groupBy("pair").agg(F.min("turn").alias("cut"))
    placed = both.join(first, "pair", "left")
    shared = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    piece = lambda part, side: F.struct(F.lit(part).alias("part"), F.col(side).alias("t"))
    parts = F.when(shared, F.array(piece("prompt", "chosen"))).otherwise(F.filter(F.array(piece("chosen", "chosen"), piece("rejected", "rejected")), lambda p: p["t"].isNotNull()))
    rows = placed.select("pair", "turn", F.explode(parts).alias("p"))
    return rows.select(
        "pair", F.col("p.part").alias("part"), "turn", F.col("p.t.role").alias("role"), rendered(F.col("p.t.role"), F.col("p.t.text")).alias("rendered"),
        ((F.col("p.part") != "prompt") & (F.col("p.t.role") == "assistant")).alias("train"),
    )


def echo_pairs(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
    """(chosen, rejected) made from plain conversations.

    Chosen is a conversation up to its last assistant turn. Rejected has one answer replaced
    by the text of the turn before it (empty if there is none), by the conversation's CRC-32
    modulo 3: 0, the last answer; 1, the first one, and it ends there; 2, the first one, and
    it goes on like the chosen side. Conversations without an assistant turn give no pair.
    """
    rows = conversations.select(F.col(conv).alias("pair"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = settle(turns(rows, "t").select("pair", "turn", "t.role", "t.text"))
    answers = rows.where("role = 'assistant'").groupBy("pair").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    kind = F.pmod(F.crc32(F.col("pair").cast("string")), F.lit(3))
    ends = answers.select("pair", "last", F.when(kind == 0, F.col("last")).otherwise(F.col("first")).alias("at"), F.when(kind == 1, F.col("first")).otherwise(F.col("last")).alias("until"))
    sides = rows.join(ends, "pair").where("turn <= last")
    before = sides.where("turn < at").groupBy("pair").agg(F.max(F.struct("turn", "text")).alias("b")).select("pair", F.col("b.text").alias("echo"))
    answer = F.when(F.col("turn") == F.col("at"), F.coalesce("echo", F.lit(""))).otherwise(F.col("text")).alias("text")
    rejected = sides.where("turn <= until").join(before, "pair", "left").select("pair", "turn", "role", answer)
    return sides.select("pair", "turn", "role", "text"), rejected
