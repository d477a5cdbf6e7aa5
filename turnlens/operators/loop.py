"""The adaptive loop, turn by turn over all conversations at once.

A turn of every conversation is one plan: ask, retrieve and answer, grade,
choose the next type, write the next question. The state between turns is one
row a conversation, kept in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.functions import match
from turnlens.lineage import kept
from turnlens.operators import control, graph, systems
from turnlens.operators.retrieval import extractive_from

ABSTENTION = "This cannot be answered from the documents."


def run(seeds: DataFrame, chunks: DataFrame, turns: int = 4, system: str = "vector", forced: tuple[str, ...] = ()) -> DataFrame:
    """(qid, turn_id, query_type, question, gold, answer, outcome) for seeds (qid, question, gold, passage).

    The system sees its own last answer as history. A question that the
    passage cannot answer has the abstention as its gold.
    """
    answer_with = systems.connect(system)
    options = {"indexed": systems.index(chunks)} if system == "vector" else {}
    e = graph.entities(F.col("passage"))
    state = seeds.select(
        "qid", "passage", "question", "gold", F.lit("Seed").alias("query_type"), F.lit(0).cast("long").alias("n_correct"), F.lit("").alias("said"), F.get(e, F.lit(0)).alias("e0"), F.get(e, F.lit(1)).alias("e1")
    )
    done: DataFrame | None = None
    for t in range(turns):
        asked = state.withColumn("query", F.trim(F.concat_ws(" ", "said", "question")))
        got = state.join(answer_with(asked.select("qid", "question", "query"), chunks, **options).select("qid", "answer"), "qid")
        graded = kept(got.withColumn("outcome", match.grade(F.col("gold"), F.col("answer"), F.col("query_type") == "Unanswerable")))
        rows = graded.select("qid", F.lit(t).cast("long").alias("turn_id"), "query_type", "question", "gold", "answer", "outcome")
        done = rows if done is None else done.unionByName(rows)
        n = F.col("n_correct") + F.when(F.col("outcome") == "correct", 1).otherwise(0)
        kind = control.forced(F.lit(t), forced) if forced else control.next_type(F.col("outcome"), F.col("query_type"), n, F.lit(t))
        said = F.concat_ws(" ", "question", "answer")
        moved = graded.select("qid", "passage", "e0", "e1", kind.alias("query_type"), n.alias("n_correct"), said.alias("said")).withColumn("question", control.template(F.col("query_type"), F.col("e0"), F.col("e1")))
        gold = F.when(F.col("query_type") == "Unanswerable", ABSTENTION).otherwise(extractive_from(F.col("question"), F.array("passage")))
        state = moved.withColumn("gold", gold)
    return done
