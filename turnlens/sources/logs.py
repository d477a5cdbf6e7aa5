"""Conversation logs: nested JSON in, flat turns out, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOC = "struct<doc_id:string,rank:int,score:double,score_type:string,text:string,title:string>"
TURN = (
    "struct<turn_id:int,query_type:string,question:string,gold:string,evidence:string,rag_answer:string,outcome:string,is_unanswerable:boolean,guard_gave_up:boolean,"
    f"question_evidence:string,rag_retrieved_context:array<string>,cf_outcome:string,expected_components:array<string>,rag_retrieved_documents:array<{DOC}>,generation_source:string>"
)
LOG = f"method string, rag string, dataset string, seed int, n_turns int, conversations array<struct<conversation_id:string,seed_question:string,turns:array<{TURN}>>>"


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """Run files below ``root`` with their path; files that do not parse, or hold no conversations, are left out."""
    raw = spark.read.schema(LOG + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    return raw.withColumn("path", F.input_file_name()).filter("conversations is not null").drop("_bad")


def path_dimensions(logs: DataFrame) -> DataFrame:
    """Method, system, corpus and conversation from .../method/rag/dataset/conversation_NNN/file."""
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    return logs.withColumns({"path_method": part(5), "path_rag": part(4), "path_dataset": part(3), "path_conversation": part(2)})


def turns(logs: DataFrame) -> DataFrame:
    """One row a turn, with its run and conversation."""
    convs = logs.select("path", "method", "rag", "dataset", F.explode("conversations").alias("c"))
    return convs.select("path", "method", "rag", "dataset", "c.conversation_id", F.explode("c.turns").alias("t")).select("path", "method", "rag", "dataset", "conversation_id", "t.*")


def failed_turns(flat: DataFrame, abstained: bool = False) -> DataFrame:
    """Wrong and hallucinated turns (and answerable abstentions on demand) with all messages before them."""
    w = Window.partitionBy("path", "conversation_id").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, -1)
    said = F.collect_list(F.struct("question", F.col("rag_answer").alias("answer"))).over(w)
    rows = flat.withColumn("history", said).withColumn("evidence", F.coalesce(F.when(F.col("evidence") != "", F.col("evidence")), "question_evidence"))
    bad = F.col("outcome").isin("wrong", "hallucinated")
    return rows.filter(bad | ((F.col("outcome") == "abstained") & ~F.coalesce("is_unanswerable", F.lit(False))) if abstained else bad)


def write_turns(flat: DataFrame, path: str, overwrite: bool = False) -> None:
    """Append conversations that are not stored yet, partitioned by run (all of them with ``overwrite``)."""
    keys = ["method", "rag", "dataset"]
    spark = flat.sparkSession
    if not overwrite:
        try:
            there = spark.read.parquet(path).select(*keys, "conversation_id").distinct()
            flat = flat.join(there, [*keys, "conversation_id"], "left_anti")
        except Exception as e:  # nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    flat.write.mode("overwrite" if overwrite else "append").partitionBy(*keys).parquet(path)
