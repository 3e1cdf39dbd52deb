"""Chat formatting for preference training, in DataFrame functions alone.

A row holds a chosen and a rejected conversation (arrays of turns). Their longest common prefix of turns is rendered once
as the prompt; what is left of either side is rendered as its completion, with the spans of characters that the model
is to learn: the contents of assistant turns. A turn is ``<|role|>`` on a line, its text, and ``<|end|>`` on a line.

Plan. Pairs are rows; formatting is a projection. ``conversations`` gathers the turns of a conversation, which is one row
by its nature; roles and texts of turns are all that is shuffled.

Defined results: a null role or text is ''; a turn with a null key is a conversation of its own; a conversation without turns (null or empty) has no prefix and an empty
completion; equal conversations are all prompt and both completions are empty; turns of one number are in order of role,
then text; repeated rows are repeated turns; offsets are code points in the completion, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
LEARNED = "assistant"
TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns) with a conversation's turns in order."""
    part = F.struct(F.col(order).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col(key).alias("conv_id"), own.alias("own"), part.alias("part"))
    gathered = rows.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list("part")).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("\n" + END))), "")


def _mask(turns: Column) -> Column:
    """Spans (start, end) of assistant contents in the rendered turns."""
    long = lambda c: c.cast("long")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + long(F.length(_head(turn)))
        end = start + long(F.length(turn["text"]))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1 + len(END)).alias("at"), F.when(turn["role"] == LEARNED, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def format_preferences(pairs: DataFrame, key: str = "conv_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """key, n_prompt_turns, prompt, chosen, rejected, chosen_mask and rejected_mask of every row."""
    none = F.array().cast(f"array<{TURN}>")
    x = pairs.select(F.col(key).alias("key"), F.coalesce(F.col(chosen), none).alias("a"), F.coalesce(F.col(rejected), none).alias("b"))
    # the prefix ends at the first place where the turns differ, or where the shorter side ends
    same = F.zip_with("a", "b", lambda p, q: F.coalesce((p["role"] == q["role"]) & (p["text"] == q["text"]), F.lit(False)))
    first = F.array_position(same, False)
    x = x.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    x = x.select("key", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest(F.col("a")).alias("a"), rest(F.col("b")).alias("b"))
    return x.select(
        F.col("key").alias(key), F.col("n").cast("long").alias("n_prompt_turns"), _render(F.col("p")).alias("prompt"),
        _render(F.col("a")).alias("chosen"), _render(F.col("b")).alias("rejected"), _mask(F.col("a")).alias("chosen_mask"), _mask(F.col("b")).alias("rejected_mask"),
    )


def echoed(conversation: Column) -> Column:
    """A worse variant of a conversation: its last assistant turn repeats the turn before it (or is empty, as the first)."""
    back = F.array_position(F.reverse(F.transform(conversation, lambda t: t["role"])), LEARNED)
    last = F.when(back > 0, F.size(conversation) - back + 1).otherwise(0)
    before = F.coalesce(F.try_element_at(conversation, F.nullif(last - 1, F.lit(0)).cast("int"))["text"], F.lit(""))
    return F.transform(conversation, lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == last, before).otherwise(t["text"]).alias("text")))
