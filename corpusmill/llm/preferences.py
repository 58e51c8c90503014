"""Preference pairs as one prompt and two masked completions.

Native DataFrame functions. A pair names a chosen and a rejected conversation.
Their turns are compared by number in order (role and text; a null equals a
null): the turns before the first difference are the prompt, rendered once; the
rest of each conversation is its completion. In a completion only what the
assistant says, with the end mark of its turn, is to be learned; the mask gives
those parts as spans (start, end) of code points, everything else is masked.

Turns are gathered only per conversation and pair, the unit of the result. A
conversation named in many pairs is joined to them by its id, where Spark can
split a skewed join.

Defined cases: turns go by their number, then role and text; repeated rows of a
turn count once; turns without a number or a conversation are left out; a null
role is rendered as "", a null text as ""; a conversation that has no rows is
empty, so a pair with one missing side has an empty prompt; equal conversations
have empty completions; pairs with a null pair id or side are left out; extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the chat format.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNED = "assistant"


def adjacent_pairs(conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(pair_id, chosen, rejected): of every two ids 2 n and 2 n + 1 that occur,
    the even one as chosen; a missing side stays in the pair."""
    ids = conversations.where(F.col(conversation).isNotNull()).select(F.col(conversation).cast("long").alias("id")).distinct()
    n = F.floor(F.col("id") / 2)
    return ids.groupBy(n.alias("pair_id")).agg(F.lit(1).alias("_")).select("pair_id", (2 * F.col("pair_id")).alias("chosen"), (2 * F.col("pair_id") + 1).alias("rejected"))


def numbered(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Distinct turns (id, n from 0 on, role, text) in order."""
    rows = conversations.where(F.col(conversation).isNotNull() & F.col(turn).isNotNull())
    rows = rows.select(F.col(conversation).cast("long").alias("id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    return rows.select("id", (F.row_number().over(order) - 1).alias("n"), "role", "text")


def alternative_endings(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs (pair_id, chosen, rejected) and their conversations, one pair for each
    conversation ``c``: it is chosen (id 2 c), rejected (2 c + 1) is a model that
    repeats itself: the conversation up to its last assistant turn, which says what
    the assistant's turn before said (nothing, if there is none). A conversation
    without an assistant turn is paired with itself."""
    turns = numbered(conversations, conversation, turn, role, text)
    is_answer = F.col("role") == LEARNED
    whole = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    seen = turns.withColumns(
        {
            "last": F.max(F.when(is_answer, F.col("n"))).over(whole),
            "stale": F.coalesce(F.last(F.when(is_answer, F.col("text")), ignorenulls=True).over(before), F.lit("")),
        }
    )
    at_last = F.col("n") == F.col("last")
    said = F.array(
        F.struct((2 * F.col("id")).alias("id"), F.col("text").alias("text"), F.lit(True).alias("stays")),
        F.struct((2 * F.col("id") + 1).alias("id"), F.when(at_last, F.col("stale")).otherwise(F.col("text")).alias("text"), F.coalesce(F.col("n") <= F.col("last"), F.lit(True)).alias("stays")),
    )
    both = seen.select(F.col("n").alias("turn"), "role", F.explode(said).alias("s")).where("s.stays").select(F.col("s.id").alias("conv_id"), "turn", "role", "s.text")
    ids = conversations.where(F.col(conversation).isNotNull()).select(F.col(conversation).cast("long").alias("pair_id")).distinct()
    return ids.select("pair_id", (2 * F.col("pair_id")).alias("chosen"), (2 * F.col("pair_id") + 1).alias("rejected")), both


def rendered(turns: Column) -> Column:
    """The turns (role, text) of a part of a conversation as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def learned(turns: Column) -> Column:
    """Spans of what is learned in ``rendered(turns)``."""

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + F.length(t["role"]) + len(START) + len(MIDDLE)
        b = a + F.length(t["text"]) + len(END)
        one = F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(t["role"] == LEARNED, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def formatted(pairs: DataFrame, conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per pair (pair_id, chosen, rejected): n_prompt turns, prompt, and for both
    sides the completion and the spans to learn."""
    wanted = pairs.where("pair_id is not null and chosen is not null and rejected is not null").select("pair_id", "chosen", "rejected").distinct()
    turns = numbered(conversations, conversation, turn, role, text)
    # each conversation's turns once per pair and side
    sides = wanted.select("pair_id", "chosen", "rejected", F.explode(F.array(F.struct(F.lit(True).alias("c"), F.col("chosen").alias("id")), F.struct(F.lit(False).alias("c"), F.col("rejected").alias("id")))).alias("s"))
    sides = sides.select("pair_id", "chosen", "rejected", F.col("s.c").alias("is_chosen"), F.col("s.id").alias("id"))
    rows = sides.join(turns, "id", "left")
    said = F.struct("n", "role", "text")
    by_side = rows.groupBy("pair_id", "chosen", "rejected", "is_chosen").agg(F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), said))).alias("turns"))
    both = by_side.groupBy("pair_id", "chosen", "rejected").agg(
        F.first(F.when(F.col("is_chosen"), F.col("turns")), ignorenulls=True).alias("c"), F.first(F.when(~F.col("is_chosen"), F.col("turns")), ignorenulls=True).alias("r")
    )
    differs = F.filter(F.arrays_zip("c", "r"), lambda x: ~x["c"].eqNullSafe(x["r"]))
    n = F.coalesce(F.get(differs, 0)["c"]["n"], F.get(differs, 0)["r"]["n"], F.size("c"))
    cut = both.withColumn("n_prompt", n)

    def rest(c: str) -> Column:
        return F.filter(F.col(c), lambda t: t["n"] >= F.col("n_prompt"))

    return cut.select(
        "pair_id",
        "chosen",
        "rejected",
        F.col("n_prompt").cast("long").alias("n_prompt"),
        rendered(F.filter(F.col("c"), lambda t: t["n"] < F.col("n_prompt"))).alias("prompt"),
        rendered(rest("c")).alias("chosen_completion"),
        learned(rest("c")).alias("chosen_spans"),
        rendered(rest("r")).alias("rejected_completion"),
        learned(rest("r")).alias("rejected_spans"),
    )
