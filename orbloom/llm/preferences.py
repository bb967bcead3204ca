"""Preference formatting: one prompt, two masked completions, in DataFrame expressions only.

The longest common turn prefix of the chosen and the rejected conversation is rendered once as the prompt; what
follows in each is its completion.  A completion comes with the spans of its text that count for the loss: the
texts of assistant turns with their end marks.  Everything else (role headers, other roles' turns) is masked.

Defined results: a null role is the empty role and a null text the empty text; a missing conversation is empty,
so its completion is empty and the common prefix too; identical conversations have empty completions; turns are
ordered by (turn, role, text), so repeated turn numbers have a defined order; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, NECK, END = "<|", "|>\n", "<|end|>\n"  # fixed values: turn markup
TRAINED_ROLE = "assistant"
MESSAGE = "struct<role:string,text:string>"


def conversations_as_arrays(turns: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order; a conversation's own turns meet in one group."""
    one = F.struct(turns["turn"], F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"))
    return turns.where(turns["conv_id"].isNotNull()).groupBy(turns["conv_id"].alias("conv_id")).agg(
        F.transform(F.sort_array(F.collect_list(one)), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages")
    )


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are equal in role and text."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    return F.coalesce(F.array_min(differs) - 1, n)


def rendered(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(HEAD), m["role"], F.lit(NECK), m["text"], F.lit(END))), "")


def _length(m: Column) -> Column:
    return F.length(m["role"]) + F.length(m["text"]) + (len(HEAD) + len(NECK) + len(END))


def trained_spans(messages: Column) -> Column:
    """[start, end) in characters of what counts for the loss in ``rendered(messages)``."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, m: Column) -> Column:
        start = state["at"] + len(HEAD) + len(NECK) + F.length(m["role"])
        after = state["at"] + _length(m)
        span = F.array(F.struct(start.cast("int").alias("start"), after.cast("int").alias("end")))
        return F.struct(after.cast("int").alias("at"), F.when(m["role"] == TRAINED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(messages, zero, add)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, chosen and rejected (arrays of role and text) to prompt, completions and their masks."""
    none = F.array().cast(f"array<{MESSAGE}>")
    p = pairs.select(pairs["pair_id"].alias("pair_id"), F.coalesce(pairs["chosen"], none).alias("c"), F.coalesce(pairs["rejected"], none).alias("r"))
    p = p.withColumn("n", common_prefix(F.col("c"), F.col("r")))

    def rest(x: str) -> Column:
        return F.slice(F.col(x), F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))

    return p.select(
        "pair_id",
        F.col("n").cast("int").alias("prompt_turns"),
        rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"),
        rendered(rest("r")).alias("rejected"),
        trained_spans(rest("c")).alias("chosen_spans"),
        trained_spans(rest("r")).alias("rejected_spans"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs the conversations 2k (chosen) and 2k + 1 (rejected); one without a partner meets an empty one."""
    c = conversations_as_arrays(turns).withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("long"))
    odd = F.pmod(F.col("conv_id"), F.lit(2)) == 1
    # A pair has two members at most, so the group that brings them together is small.
    return c.groupBy("pair_id").agg(F.first(F.when(~odd, F.col("messages")), ignorenulls=True).alias("chosen"), F.first(F.when(odd, F.col("messages")), ignorenulls=True).alias("rejected"))
