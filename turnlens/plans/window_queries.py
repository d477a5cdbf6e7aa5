"""Queries over ordered conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.functions import guards
from turnlens.functions import text as t
from turnlens.plans import text_queries as tq
from turnlens.plans import views as v
from turnlens.plans.oracle import sql, tokens


def _conv(order: str = "turn_id", key: str = "conversation_id"):
    return Window.partitionBy(key).orderBy(order)


def prev_turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    w = _conv()
    pairs = v.log(spark, sf).select("conversation_id", "turn_id", "query_type", "outcome", F.lag("outcome").over(w).alias("prev_outcome"), F.lag("query_type", 1, "").over(w).alias("prev_type"))
    return pairs.filter("prev_outcome is not null")


def history_k(spark: SparkSession, sf: str) -> DataFrame:
    """Each message with the 2 messages before it as a query, and the length of the last 4 and 6."""
    w = _conv("turn", "conv_id")
    last = lambda k: F.array_join(F.collect_list("text").over(w.rowsBetween(-k, -1)), " ")
    return v.msgs(spark, sf).select("conv_id", "turn", F.trim(F.concat_ws(" ", last(2), "text")).alias("query"), F.length(last(4)).cast("long").alias("n4"), F.length(last(6)).cast("long").alias("n6"))


def prior_history(spark: SparkSession, sf: str) -> DataFrame:
    w = _conv("turn_id", "conv_id").rowsBetween(Window.unboundedPreceding, -1)
    said = F.concat(F.lit("user: "), F.col("question"), F.lit("\nassistant: "), F.col("gold"))
    return v.qa_turns(spark, sf).select("conv_id", "turn_id", F.count(F.lit(1)).over(w).alias("n_prior"), F.substring(F.array_join(F.collect_list(said).over(w), "\n"), 1, 600).alias("history"))


def running_correct(spark: SparkSession, sf: str) -> DataFrame:
    w = _conv().rowsBetween(Window.unboundedPreceding, 0)
    return v.log(spark, sf).select("conversation_id", "turn_id", F.sum(F.when(F.col("outcome") == "correct", 1).otherwise(0)).over(w).alias("n_correct"))


def repeat_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each conversation, and those that repeat an earlier answer."""
    return tq.jaccard_repeat(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if("repeat").alias("dup_turns"))


def rank_renumber(spark: SparkSession, sf: str) -> DataFrame:
    kept = tq.lexical_topk(spark, sf).filter("rank <> 2")
    return kept.select("item_id", "chunk_id", F.row_number().over(Window.partitionBy("item_id").orderBy("rank")).cast("long").alias("rank"), "score")


def unit_grouping(spark: SparkSession, sf: str) -> DataFrame:
    """Long units: five consecutive chunks of a document, joined by line ends."""
    units = v.chunks(spark, sf).groupBy("doc_id", F.floor(F.col("pos") / 5).alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c"))
    return units.select("doc_id", "unit", "n", F.md5(F.array_join(F.col("c.text"), "\n")).alias("text_md5"))


def last_assistant(spark: SparkSession, sf: str) -> DataFrame:
    w = _conv("turn", "conv_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = v.msgs(spark, sf).select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(w).alias("assistant_turn"))
    return rows.filter("role = 'user'").drop("role")


def covered_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last eight answers before each turn, as a count and the first words of each."""
    w = _conv("turn_id", "conv_id").rowsBetween(-8, -1)
    return v.qa_turns(spark, sf).select("conv_id", "turn_id", F.count(F.lit(1)).over(w).alias("n_tail"), F.array_join(F.collect_list(F.substring("gold", 1, 12)).over(w), "|").alias("tail"))


def dialogue_pairing(spark: SparkSession, sf: str) -> DataFrame:
    return v.qa_turns(spark, sf)


def dialogue_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Answered turns as samples; canned abstentions go; ids carry conversation and message."""
    w = _conv("turn", "conv_id")
    rows = v.msgs(spark, sf).select("conv_id", "turn", "role", "text", F.lag("role").over(w).alias("r"), F.lag("text").over(w).alias("question"))
    kept = rows.filter("role = 'assistant' and r = 'user' and turn % 11 <> 0 and trim(text) <> '' and trim(question) <> ''")
    return kept.select(F.format_string("mtrag-%s-%03d-%02d", F.lit("conversations"), "conv_id", "turn").alias("id"), F.trim("question").alias("question"), F.trim("text").alias("answer"))


def failed_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Failed turns (and answerable abstentions) with the outcomes before them."""
    w = _conv().rowsBetween(Window.unboundedPreceding, -1)
    rows = v.log(spark, sf).select("conversation_id", "turn_id", "query_type", "outcome", F.array_join(F.collect_list(F.substring("outcome", 1, 1)).over(w), "").alias("history"))
    bad = F.col("outcome").isin("wrong", "hallucinated") | ((F.col("outcome") == "abstained") & (F.col("query_type") != "Unanswerable"))
    return rows.filter(bad)


def lead_links(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive question types of a conversation, counted."""
    rows = v.log(spark, sf).select("query_type", F.lead("query_type").over(_conv()).alias("next_type"))
    return rows.filter("next_type is not null").groupBy("query_type", "next_type").agg(F.count(F.lit(1)).alias("n"))


def first_failure(spark: SparkSession, sf: str) -> DataFrame:
    """The first failed turn of each conversation that has one."""
    bad = v.log(spark, sf).filter(F.col("outcome").isin("wrong", "hallucinated"))
    return bad.groupBy("conversation_id").agg(F.min("turn_id").alias("turn_id"), F.min_by("query_type", "turn_id").alias("query_type"))


QUERIES = {f.__name__: f for f in (
    prev_turn_pairs, history_k, prior_history, running_correct, repeat_answers, rank_renumber, unit_grouping, last_assistant, covered_tail, dialogue_pairing, dialogue_flatten, failed_turns, lead_links, first_failure,
)}

_W = "WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_id)"
SQL = {
    "prev_turn_pairs": sql(f"SELECT * FROM (SELECT conversation_id, turn_id, query_type, outcome, lag(outcome) OVER w AS prev_outcome, lag(query_type, 1, '') OVER w AS prev_type FROM log {_W}) WHERE prev_outcome IS NOT NULL", "log"),
    "history_k": """SELECT conv_id, turn, trim(concat_ws(' ', coalesce(h2, ''), text)) AS query, length(coalesce(h4, '')) AS n4, length(coalesce(h6, '')) AS n6 FROM (
        SELECT *, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' ') AS h2, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ' ') AS h4,
          array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), ' ') AS h6 FROM conversations)""",
    "prior_history": sql(
        """SELECT conv_id, turn_id, n_prior, substring(coalesce(h, ''), 1, 600) AS history FROM (SELECT conv_id, turn_id, count(*) OVER w AS n_prior, array_to_string(list('user: ' || question || E'\\nassistant: ' || gold) OVER w, E'\\n') AS h
           FROM qa_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        "qa_turns",
    ),
    "running_correct": sql("SELECT conversation_id, turn_id, sum(CASE WHEN outcome = 'correct' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY turn_id ROWS UNBOUNDED PRECEDING)::BIGINT AS n_correct FROM log", "log"),
    "repeat_answers": f"SELECT conv_id, count(*) AS n_turns, count(*) FILTER (repeat) AS dup_turns FROM ({tq.SQL['jaccard_repeat']}) GROUP BY conv_id",
    "rank_renumber": sql("SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank, score FROM top5 WHERE rank <> 2", "top5"),
    "unit_grouping": sql("SELECT doc_id, pos // 5 AS unit, count(*) AS n, md5(string_agg(text, E'\\n' ORDER BY pos)) AS text_md5 FROM chunks GROUP BY doc_id, pos // 5", "chunks"),
    "last_assistant": "SELECT conv_id, turn, assistant_turn FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS assistant_turn FROM conversations) WHERE role = 'user'",
    "covered_tail": sql("SELECT conv_id, turn_id, count(*) OVER w AS n_tail, coalesce(array_to_string(list(substring(gold, 1, 12)) OVER w, '|'), '') AS tail FROM qa_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)", "qa_turns"),
    "dialogue_pairing": sql("SELECT conv_id, turn_id, question, gold FROM qa_turns", "qa_turns"),
    "dialogue_flatten": """SELECT format('mtrag-conversations-{:03d}-{:02d}', conv_id, turn) AS id, trim(question) AS question, trim(text) AS answer FROM (
        SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS question FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND r = 'user' AND turn % 11 <> 0 AND trim(text) <> '' AND trim(question) <> ''""",
    "failed_turns": sql(
        """SELECT conversation_id, turn_id, query_type, outcome, coalesce(h, '') AS history FROM (SELECT *, array_to_string(list(outcome[1]) OVER (PARTITION BY conversation_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS h FROM log)
           WHERE outcome IN ('wrong', 'hallucinated') OR (outcome = 'abstained' AND query_type <> 'Unanswerable')""",
        "log",
    ),
    "lead_links": sql(f"SELECT query_type, next_type, count(*) AS n FROM (SELECT query_type, lead(query_type) OVER w AS next_type FROM log {_W}) WHERE next_type IS NOT NULL GROUP BY ALL", "log"),
    "first_failure": sql("SELECT conversation_id, min(turn_id) AS turn_id, arg_min(query_type, turn_id) AS query_type FROM log WHERE outcome IN ('wrong', 'hallucinated') GROUP BY conversation_id", "log"),
}
