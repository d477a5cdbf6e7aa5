"""What to ask next: the outcome-driven type controller and its alternatives."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.functions import vocab


#: Every so many-th correct answer of a conversation changes its subject.
SHIFT_EVERY = 4


def next_type(outcome: Column, last: Column, n_correct: Column, turn_id: Column) -> Column:
    """The next question type from the outcome of a turn (n_correct counts it).

    A correct answer makes questions harder, a failure asks for what went wrong
    again. No type follows itself, and a follow-up stands neither behind a hard
    question nor behind a clarification: a clarification, or behind one a
    comparison, takes its place.
    """
    hard = F.array(*(F.lit(x) for x in vocab.ESCALATION))
    harder = F.when(n_correct % SHIFT_EVERY == 0, "Topic Shift").otherwise(F.element_at(hard, (n_correct % len(vocab.ESCALATION) + 1).cast("int")))
    asks_again = F.when(turn_id % 2 == 0, "Clarification").otherwise("Follow-Up")
    wanted = F.when(outcome == "wrong", "Correction").when(outcome == "hallucinated", "Unanswerable").when(outcome == "abstained", asks_again).otherwise(harder)
    unfit = (wanted == last) | ((wanted == "Follow-Up") & ((last == "Clarification") | F.array_contains(hard, last)))
    return F.when(unfit, F.when(last == "Clarification", "Comparative").otherwise("Clarification")).otherwise(wanted)


def fold(log: DataFrame, key: str = "conversation_id", start: str = "Seed") -> DataFrame:
    """(key, turn_id, next_type) of logged outcomes: one fold over each conversation's ordered turns, without Python."""
    turns = log.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn_id", "outcome"))).alias("turns"))
    zero = F.struct(F.lit(start).alias("last"), F.lit(0).cast("long").alias("n"), F.expr("cast(array() as array<struct<turn_id:bigint,next_type:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + F.when(x["outcome"] == "correct", 1).otherwise(0)
        kind = next_type(x["outcome"], acc["last"], n, x["turn_id"])
        return F.struct(kind.alias("last"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(x["turn_id"].alias("turn_id"), kind.alias("next_type")))).alias("out"))

    return turns.select(key, F.explode(F.aggregate("turns", zero, step)["out"]).alias("x")).select(key, "x.turn_id", "x.next_type")


def forced(turn_id: Column, types: Sequence[str]) -> Column:
    """A fixed cycle of types."""
    return F.element_at(F.array(*(F.lit(x) for x in types)), (turn_id % len(types) + 1).cast("int"))


def template(kind: Column, e0: Column, e1: Column) -> Column:
    """A question of each type about one or two entities, without a model."""
    names = {"{0}": F.coalesce(e0, F.lit(vocab.MAIN_SUBJECT)), "{1}": F.coalesce(e1, e0, F.lit(vocab.MAIN_SUBJECT))}
    out = F.lit(None).cast("string")
    for name, text in vocab.TEMPLATES.items():
        parts = [names.get(x, F.lit(x)) for x in re.split(r"(\{[01]\})", text) if x]
        out = F.when(kind == name, F.concat(*parts)).otherwise(out)
    return out


def random_type(seed: int, *keys: Column) -> Column:
    """A type drawn by a seed and the keys of a turn, each as likely as any other."""
    types = F.array(*(F.lit(t[0]) for t in vocab.QUERY_TYPES))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))), 1, 8), 16, 10).cast("long")
    return F.element_at(types, (drawn % len(vocab.QUERY_TYPES) + 1).cast("int"))
