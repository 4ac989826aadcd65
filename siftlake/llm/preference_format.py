"""Preference formatting with DataFrame functions only: a shared prompt and two masked completions for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


def conversations_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns (role, text), in the order of turn and, where that ties, of role and text.

    Null roles and texts are empty; a null turn comes first; each row without conv_id is a conversation of its own (one array
    of all of them would have no bound). Repeated rows are turns of their own.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    alone = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    listed = turns.select(F.col(conv_id).alias("conv_id"), alone.alias("alone"), one.alias("one")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return listed.drop("alone").withColumn("turns", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))


def graft_rejected(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected of each conversation: rejected is its turns before the last assistant turn, and then the turns
    from the last assistant turn on of its neighbour (conv_id with the lowest bit flipped); none if there is no neighbour.

    Without an assistant turn all turns stand before.
    """
    last = F.coalesce(F.array_max(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i))), F.size("turns"))
    cut = conversations.withColumn("last", last)
    tail = F.slice("turns", F.col("last") + 1, F.greatest(F.size("turns") - F.col("last"), F.lit(0)))
    other = cut.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), tail.alias("tail"))
    head = F.slice("turns", F.lit(1), F.col("last"))
    rejected = F.concat(head, F.coalesce("tail", F.array().cast(TURNS)))
    return cut.join(other, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(CLOSE + "\n"))), "")


def trained_spans(turns: Column, role: str) -> Column:
    """start and stop (code points of the rendered turns) of what is learnt: the role's texts and their closing marks."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + len(OPEN) + F.length(x["role"]) + 1
        stop = start + F.length(x["text"]) + len(CLOSE)
        one = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct((stop + 1).alias("at"), F.when(x["role"] == role, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """pairs without chosen and rejected, with n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    chosen and rejected are arrays of (role, text). The longest prefix of equal turns is rendered once, as prompt; the rest of
    each conversation is its completion, and its spans are what a model learns (everything else is masked). Null arrays are
    empty; equal conversations have two empty completions; an empty table gives no rows. Columns named like the results are
    replaced.
    """
    side = lambda c: F.coalesce(F.col(c), F.array().cast(TURNS))
    same = F.zip_with(side("chosen"), side("rejected"), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    n = F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")
    rest = lambda c: F.slice(side(c), F.col("__n") + 1, F.greatest(F.size(side(c)) - F.col("__n"), F.lit(0)))
    results = ("chosen", "rejected", "n_prompt_turns", "prompt", "chosen_spans", "rejected_spans")
    names = [c for c in pairs.columns if c.lower() not in results]
    found = pairs.select(F.struct(*(F.col(f"`{c}`") for c in names), F.lit(True)).alias("own"), "chosen", "rejected").withColumn("__n", n)
    found = found.withColumns({"__p": F.slice(side("chosen"), F.lit(1), F.col("__n")), "__c": rest("chosen"), "__r": rest("rejected")})
    return found.select(
        *(F.col("own").getField(c).alias(c) for c in names),
        F.col("__n").alias("n_prompt_turns"),
        rendered(F.col("__p")).alias("prompt"),
        rendered(F.col("__c")).alias("chosen"),
        rendered(F.col("__r")).alias("rejected"),
        trained_spans(F.col("__c"), role).alias("chosen_spans"),
        trained_spans(F.col("__r"), role).alias("rejected_spans"),
    )


def spans_text(spans: str) -> Column:
    """Spans as start-stop, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"], x["stop"])), ",")
