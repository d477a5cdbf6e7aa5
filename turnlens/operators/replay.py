"""Seeds, plans of question types, sub-questions and replayed conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions import vocab
from turnlens.functions.text import sentences
from turnlens.operators.retrieval import extractive


def has_label(question: Column) -> Column:
    """Whether a question names a table, figure, section, citation or equation by its label."""
    return F.coalesce(question, F.lit("")).rlike(vocab.LABEL)


def usable_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds with an answer and a context, without those whose question names a label, unless that leaves none.

    Whether any is left is one value, found by an aggregate and broadcast.
    """
    usable = seeds.filter((F.coalesce("answer", F.lit("")) != "") & (F.size("context") > 0)).withColumn("_ok", ~has_label(F.col("question")))
    some = usable.agg(F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("_some"))
    return usable.crossJoin(F.broadcast(some)).filter("_ok or not _some").drop("_ok", "_some")


def corpus_seeds(turns: DataFrame, domain: int, n: int, first_n: bool) -> DataFrame:
    """First turns of a domain: those among the first ``n`` conversations of all, or the first ``n`` of the domain."""
    if first_n:
        return turns.orderBy("conv_id").limit(n).filter(F.col("domain") == domain)
    return turns.filter(F.col("domain") == domain).orderBy("conv_id").limit(n)


def classed(subs: DataFrame, classes: DataFrame) -> DataFrame:
    """Sub-questions with the class returned for their text; a missing or unknown one is core."""
    valid = classes.filter(F.col("class").isin(*vocab.SUB_CLASSES))
    return subs.join(valid, "question", "left").withColumn("class", F.coalesce("class", F.lit(vocab.SUB_CLASSES[0])))


def by_priority(subs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``subs`` with place: core before background before follow-up, in their order otherwise."""
    rank = F.array_position(F.array(*(F.lit(c) for c in vocab.SUB_CLASSES)), F.col("class"))
    return subs.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "pos")))


def plan(key: Column, seed: int, turns: int) -> Column:
    """Types of the turns of a planned conversation: the seed's, types drawn in seeded order, late ones last, in a cycle."""
    kinds = [t[0] for t in vocab.QUERY_TYPES if t[0] != "Follow-Up"]
    drawn = F.array_sort(F.array(*(F.struct(F.lit(int(k in vocab.LATE_TYPES)).alias("late"), F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(k))).alias("h"), F.lit(k).alias("k")) for k in kinds)))
    return F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda i: F.when(i == 0, "Follow-Up").otherwise(F.element_at(drawn, (i - 1) % len(kinds) + 1)["k"]))


def replayed(turns: DataFrame) -> DataFrame:
    """Human turns (conv_id, turn_id, question, gold, label) with the history that the system is asked with.

    Its own answers stand in the history: without a system, the first sentence of the
    reference, and the abstention where the label says that there is no answer.
    """
    none = F.col("label") == vocab.UNANSWERABLE
    said = F.when(none, vocab.NO_ANSWER).otherwise(F.element_at(sentences(F.col("gold")), 1))
    line = F.concat(F.lit("user: "), "question", F.lit("\nassistant: "), said)
    w = Window.partitionBy("conv_id").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, -1)
    return turns.select("conv_id", "turn_id", "question", none.alias("is_unanswerable"), (2 * F.count(F.lit(1)).over(w)).alias("n_history"), F.array_join(F.collect_list(line).over(w), "\n").alias("history"))


def gold_answers(asked: DataFrame, evidence: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, gold_answer, abstains): the best sentence of the evidence alone; the abstention where there is none, or no answer."""
    have = evidence.select(key).distinct().withColumn("_have", F.lit(True))
    rows = asked.join(extractive(asked, evidence, key), key).join(have, key, "left")
    abstains = F.col("is_unanswerable") | F.col("_have").isNull()
    return rows.select(key, F.when(abstains, vocab.NO_ANSWER).otherwise(F.col("answer")).alias("gold_answer"), abstains.alias("abstains"))
