"""Preference formatting: one prompt and a pair of masked completions for two conversations.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once
as the prompt. What follows in each is its completion; only the assistant's turns in it are
learned from, the rest is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.merkle import with_next
from hazardlake.session import materialize

START, END = "<|im_start|>", "<|im_end|>"
_TURN = "struct<turn:bigint,role:string,text:string>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation by number; equal numbers by role and text.

    Null roles and texts are empty; rows without conv_id are left out, as no conversation has them.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    known = turns.filter(F.col("conv_id").isNotNull())
    return known.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _plain(text: Column) -> Column:
    """Text in which the template's own marks are broken up."""
    return F.replace(F.replace(text, F.lit(START), F.lit("<| im_start |>")), F.lit(END), F.lit("<| im_end |>"))


def _render(turns: Column) -> Column:
    parts = F.transform(turns, lambda t: F.concat(F.lit(START), _plain(t.role), F.lit("\n"), _plain(t.text), F.lit(END + "\n")))
    return F.array_join(parts, "")


def _spans(turns: Column, skip: Column) -> Column:
    """(start, end) of the assistant's words in the rendered turns, end mark included, less ``skip`` characters."""
    sized = F.transform(
        turns,
        lambda t: F.struct(
            (F.length(_plain(t.role)) + len(START) + 1).alias("head"),
            (F.length(_plain(t.text)) + len(END)).alias("body"),
            (t.role == "assistant").alias("learn"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state.at + x["head"] - skip
        span = F.struct(begin.alias("start"), (begin + x["body"]).alias("end"))
        return F.struct(
            (state.at + x["head"] + x["body"] + 1).alias("at"),
            F.when(x["learn"], F.concat(state.spans, F.array(span))).otherwise(state.spans).alias("spans"),
        )

    return F.aggregate(sized, start, step)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of every pair.

    ``pairs`` has pair_id and two arrays of turns (turn, role, text), chosen and rejected. Turns
    are common while role and text agree. Where both completions go on with the assistant, its
    heading belongs to the prompt. Masks are the (start, end) spans of a completion, in
    characters, that are learned from. Null arrays are empty conversations; two equal ones have
    empty completions. Marks of the template inside texts are broken up. Repeated rows come back
    as often; extra columns are ignored.
    """
    empty = F.array().cast(f"array<{_TURN}>")
    rows = pairs.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    same = F.transform(
        F.arrays_zip("c", "r"), lambda z: F.coalesce((z.c.role == z.r.role) & (z.c.text == z.r.text), F.lit(False))
    )
    broken = F.array_position(same, False)
    # Arrays of different length are zipped with nulls, so the shorter one ends the prefix too.
    cut = rows.withColumn("n", F.when(broken == 0, F.size(same)).otherwise(broken - 1).cast("int"))
    parts = cut.select(
        "pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"),
        F.slice("c", F.col("n") + 1, F.size("c")).alias("c"), F.slice("r", F.col("n") + 1, F.size("r")).alias("r"),
    )
    heading = START + "assistant\n"
    both = F.coalesce((F.get("c", F.lit(0)).role == "assistant") & (F.get("r", F.lit(0)).role == "assistant"), F.lit(False))
    skip = F.when(both, len(heading)).otherwise(0)
    rest = lambda x: F.substring(_render(F.col(x)), skip + 1, F.lit(2147483647))
    return parts.select(
        "pair_id", F.col("n").alias("prefix_turns"),
        F.concat(_render(F.col("p")), F.when(both, heading).otherwise("")).alias("prompt"),
        rest("c").alias("chosen"), rest("r").alias("rejected"),
        _spans(F.col("c"), skip).alias("chosen_mask"), _spans(F.col("r"), skip).alias("rejected_mask"),
    )


def paired_conversations(turns: DataFrame) -> DataFrame:
    """Pairs of whole conversations: (pair_id, chosen, rejected).

    Every conversation is chosen as it is. Rejected has the same turns up to its first assistant's turn and
    goes on like the conversation that follows by conv_id (after the last: the first), from that one's first assistant's turn to
    its end. A conversation without such a turn is common as a whole, and one that follows without
    adds nothing. Null roles and texts are empty; turns without conv_id are left out; equal turns stay as often as they occur.
    """
    whole = materialize(conversations(turns), "conversations")
    at = F.array_position(F.transform("turns", lambda t: t.role), "assistant")
    head = F.when(at == 0, F.col("turns")).otherwise(F.slice("turns", F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))
    tail = F.when(at == 0, F.array().cast(f"array<{_TURN}>")).otherwise(F.slice("turns", F.greatest(at, F.lit(1)).cast("int"), F.size("turns")))
    rows, window = with_next(whole.select(F.col("conv_id").alias("doc_id"), F.to_json(tail).alias("text")))
    follow = rows.withColumn("other", F.lead("text").over(window)).filter(~F.col("edge")).select(F.col("doc_id").alias("conv_id"), "other")
    return whole.join(follow, "conv_id").select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
        F.concat(head, F.from_json("other", f"array<{_TURN}>")).alias("rejected"),
    )
