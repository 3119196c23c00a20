"""Preference formatting in DataFrame functions alone.

Turns of a chosen and a rejected conversation are gathered by pair (one shuffle).  The longest run of equal
leading turns (role and text) is rendered once, as the prompt; what follows on each side is its completion.
A completion's loss mask is run-length text ``mask:characters,...``: 1 for what the assistant says and its
end mark, 0 for role headers and other roles' turns.

A pair is one training example and so one row: its turns must fit a task, as in any format of whole examples.

Cases: null texts are empty, null roles are ``unknown``; turns are ordered by turn, role and text with nulls
first, repeated rows are turns of their own; equal conversations have empty completions; a side without rows
is an empty conversation; rows with another side are no part of a pair; null pair ids are one pair; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _turns(side: str) -> F.Column:
    own = F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("turn", "role", "text"))))
    return F.transform(own, lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def _render(turns) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END))), "")


def _mask(turns) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("0:"), (F.length(t["role"]) + 5).cast("string"), F.lit(","),
        F.when(t["role"] == "assistant", "1:").otherwise("0:"), (F.length(t["text"]) + len(END)).cast("string"))), ",")


def preference_pairs(df: DataFrame, pair: str = "pair_id") -> DataFrame:
    """pair, n_prompt_turns, prompt, chosen, rejected and their masks, from rows (pair, side, turn, role, text)."""
    rows = df.filter(F.col("side").isin("chosen", "rejected")).groupBy(pair).agg(_turns("chosen").alias("c"), _turns("rejected").alias("r"))
    shared = F.least(F.size("c"), F.size("r"))
    apart = F.when(shared > 0, F.filter(F.sequence(F.lit(0), shared - 1), lambda i: F.get("c", i) != F.get("r", i)))
    rows = rows.withColumn("n", F.coalesce(F.get(apart, F.lit(0)), shared))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    return rows.select(
        pair, F.col("n").cast("long").alias("n_prompt_turns"), _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest("c")).alias("chosen"), _mask(rest("c")).alias("chosen_mask"), _render(rest("r")).alias("rejected"), _mask(rest("r")).alias("rejected_mask"))
