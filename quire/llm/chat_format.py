"""Preference formatting: chosen and rejected conversations with their common turns rendered once.

The longest common turn prefix (equal role and text, turn by turn) becomes the prompt; what follows in
each conversation becomes its completion, rendered by the same template. Masks are spans of code points
in a completion that training may learn from: text and end mark of assistant turns.

Native throughout: one aggregation gathers the turns of a pair, everything else happens in the row. A
rendered pair is one row by definition, so its turns meet in one place; no other key is used.

Defined cases: a null role or text counts as empty; turns without a pair or conversation id are one pair of
their own; turns sort by number (null first), then role and text, and repeated turns stay; a pair that lacks one side has that side empty; equal sides have empty completions and the
status `identical`; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import table, ticked

LEARNED_ROLE = "assistant"


def head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def tail(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), tail(t))), "")


def masks(turns: Column, role: str = LEARNED_ROLE) -> Column:
    """`start:end` of the learned spans of render(turns), comma-joined, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(head(t))
        end = begin + F.length(tail(t))
        span = F.array(F.concat(begin.cast("string"), F.lit(":"), (end - 1).cast("string")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of (turn, role, text), by role and text."""
    shorter = F.least(F.size(a), F.size(b))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    same = lambda i, f: F.get(a, i - 1)[f] == F.get(b, i - 1)[f]
    unlike = F.filter(places, lambda i: ~(same(i, "role") & same(i, "text")))
    return F.coalesce(F.get(unlike, F.lit(0)) - 1, shorter)


def _turn(turn: Column, role: Column, text: Column) -> Column:
    clean = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.struct(turn.alias("turn"), clean(role).alias("role"), clean(text).alias("text"))


def format_preferences(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair of turns (pair, side `chosen` or `rejected`, turn, role, text); columns as in `format_pairs`."""
    turn = _turn(ticked(turn_col), ticked(role_col), ticked(text_col))
    both = turns.groupBy(ticked(pair_col).alias("pair_id")).agg(
        F.sort_array(F.collect_list(F.when(ticked(side_col) == "chosen", turn))).alias("a"),
        F.sort_array(F.collect_list(F.when(ticked(side_col) == "rejected", turn))).alias("b"),
    )
    return format_pairs(both)


def format_pairs(both: DataFrame) -> DataFrame:
    """One row per row of both (pair_id, a, b: the turns of the chosen and the rejected side in order).

    Columns: pair_id, status, n_prompt_turns, n_chosen_turns, n_rejected_turns, prompt, chosen, rejected,
    chosen_mask, rejected_mask.
    """
    found = both.withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    found = found.select("pair_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    alone = (F.size("p") == 0) & ((F.size("a") == 0) | (F.size("b") == 0))
    status = F.when(alone, "one_sided").when((F.size("a") == 0) & (F.size("b") == 0), "identical").otherwise("paired")
    return found.select(
        "pair_id",
        status.alias("status"),
        F.size("p").cast("long").alias("n_prompt_turns"),
        F.size("a").cast("long").alias("n_chosen_turns"),
        F.size("b").cast("long").alias("n_rejected_turns"),
        render(F.col("p")).alias("prompt"),
        render(F.col("a")).alias("chosen"),
        render(F.col("b")).alias("rejected"),
        masks(F.col("a")).alias("chosen_mask"),
        masks(F.col("b")).alias("rejected_mask"),
    )


def truncated_answers(conversations: DataFrame) -> DataFrame:
    """(pair_id, a, b): the turns of every conversation, and the same with its last assistant turn cut in half.

    A cut answer is a plain negative that keeps all earlier turns equal. Conversations without an
    assistant turn have equal sides. Turns are shuffled once.
    """
    turns = F.sort_array(F.collect_list(_turn(F.col("turn"), F.col("role"), F.col("text"))))
    whole = conversations.groupBy(F.col("conv_id").alias("pair_id")).agg(turns.alias("a"), F.max(F.when(F.col("role") == LEARNED_ROLE, F.col("turn"))).alias("cut"))

    def cut(t):
        half = F.substring(t["text"], F.lit(1), F.floor(F.length(t["text"]) / 2).cast("int"))
        text = F.when((t["turn"] == F.col("cut")) & (t["role"] == LEARNED_ROLE), half).otherwise(t["text"])
        return F.struct(t["turn"].alias("turn"), t["role"].alias("role"), text.alias("text"))

    return whole.select("pair_id", "a", F.transform("a", cut).alias("b"))


def op10_preferences(spark, sf_dir: str) -> DataFrame:
    return format_pairs(truncated_answers(table(spark, sf_dir, "conversations"))).withColumnRenamed("pair_id", "conv_id")
