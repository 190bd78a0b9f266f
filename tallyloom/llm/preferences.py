"""Preference formatting: one prompt and a pair of masked completions from two conversations.

The prompt is the longest common prefix of turns of the chosen and the rejected conversation,
rendered once; the completions are what follows on either side. A mask lists the character spans of
a completion that are trained on: the text and end mark of assistant turns, not the turn heads and
not other roles.

Column expressions only. Turns are gathered per pair and side; nothing else is grouped.

Edge cases: a null role or text counts as empty; turn heads inside a text are escaped; equal
conversations give empty completions; a side that is a prefix of the other gives one empty
completion; turns that repeat a position keep the order of role and text; turns without an id
belong to no conversation; a pair that lacks a side
gives no row; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SHUT, END = "<|", "|>", "<|end|>"


def _turns(side: DataFrame, name: str) -> DataFrame:
    """(pair_id, <name>): the conversation's turns in order."""
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit(OPEN), F.lit("<\\|")).alias("text"),
    )
    return side.groupBy("pair_id").agg(F.array_sort(F.collect_list(turn)).alias(name))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(SHUT + "\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END + "\n"))), "")


def _mask(turns: Column) -> Column:
    """Spans ``start-end`` (characters, end excluded), joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(END)
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both sides as (pair_id, turn, role, text).

    Returns pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.
    """
    both = _turns(chosen, "c").join(_turns(rejected, "r"), "pair_id")
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)  # padding of the shorter side counts as different
    n = F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int")
    split = both.withColumn("n", n).select(
        "pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("prompt"),
        F.slice("c", F.col("n") + 1, F.size("c")).alias("c"), F.slice("r", F.col("n") + 1, F.size("r")).alias("r"),
    )
    return split.select(
        "pair_id", F.col("n").alias("prompt_turns"), _rendered(F.col("prompt")).alias("prompt"), _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
    )


def stale_reply_pairs(turns: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) from plain conversations: up to the last assistant turn, which the rejected
    side answers with the text of the assistant turn before it, or with an empty text if there is none.
    Conversations without an assistant turn have nothing to train on and give no pair.
    """
    base = turns.select(F.col(id_col).alias("pair_id"), "turn", "role", "text")
    spoken = Window.partitionBy("pair_id", "role").orderBy(F.desc("turn"), F.desc_nulls_last("text"))
    replies = base.where("role = 'assistant'").withColumn("back", F.row_number().over(spoken)).where("back <= 2")
    last = replies.groupBy("pair_id").agg(F.max(F.when(F.col("back") == 1, F.col("turn"))).alias("at"), F.max(F.when(F.col("back") == 2, F.col("text"))).alias("stale"))
    told = base.join(last, "pair_id").where("turn <= at")
    stale = F.when((F.col("turn") == F.col("at")) & (F.col("role") == "assistant"), F.col("stale")).otherwise(F.col("text"))
    return told.select("pair_id", "turn", "role", "text"), told.select("pair_id", "turn", "role", stale.alias("text"))
