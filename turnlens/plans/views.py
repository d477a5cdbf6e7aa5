"""Canonical views over the tables: every query starts from one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.functions.text import token_set
from turnlens.operators.retrieval import STEP

#: Characters that a paragraph has at least.
MIN_CHARS = 80
#: Chunk ids are doc_id * CHUNK_STEP + position: unique and ordered without a global sort. A document of more paragraphs would have 80 MB at least.
CHUNK_STEP = 1 << 20

TYPE_NAMES = ("Seed", "Follow-Up", "Clarification", "Comparative", "Correction", "Topic Shift", "Unanswerable", "Multi-Hop", "Ambiguous Reference")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bench(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds: the first half of a benchmark passage asks for the second."""
    half = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf, "benchmark").select(
        "item_id", F.substring("text", F.lit(1), half).alias("question"), F.substring("text", half + 1, F.length("text")).alias("gold"), "text"
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All paragraphs of documents: split at line ends, cleaned, long enough. ``pos`` says how a chunk's id comes from its document's."""
    # a run of white space has two spaces together or one of the others: bytes tell, so few paragraphs meet the pattern
    runs = lambda p: p.contains("  ") | p.contains("\t") | p.contains("\f") | p.contains("\r")
    trimmed = lambda p: F.when(runs(p), F.regexp_replace(F.trim(p), r"[ \t\n\f\r]{2,}", " ")).otherwise(F.trim(p))
    clean = F.filter(F.transform(F.split("text", "\n+"), trimmed), lambda p: F.length(p) > MIN_CHARS)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(clean).alias("pos", "text")).select(
        (F.col("doc_id") * CHUNK_STEP + F.col("pos")).alias("chunk_id"), "doc_id", F.col("pos").cast("long").alias("pos", metadata={STEP: CHUNK_STEP}), "text"
    )


def postings(units: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(token, key) of the distinct tokens of each unit."""
    return units.select(key, F.explode(token_set(F.col(text))).alias("token"))


def msgs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def qa_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant messages right after a user message, numbered from 0 in each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = msgs(spark, sf).select("conv_id", "turn", "role", "text", F.lag("role").over(w).alias("_r"), F.lag("text").over(w).alias("question"))
    return paired.filter("role = 'assistant' and _r = 'user'").select(
        "conv_id", (F.row_number().over(w) - 1).cast("long").alias("turn_id"), "question", F.col("text").alias("gold")
    )


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("emb"), "label")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a turn log (a synthetic mapping, for volume)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    outcome = F.when(F.col("event_type").isin("view", "click"), "correct").when(F.col("event_type") == "purchase", "wrong").when(F.col("event_type") == "error", "hallucinated").otherwise("abstained")
    types = F.array(*(F.lit(t) for t in TYPE_NAMES))
    return (
        table(spark, sf, "events")
        .select(
            F.col("user_id").alias("conversation_id"), (F.row_number().over(w) - 1).cast("long").alias("turn_id"), outcome.alias("outcome"),
            F.element_at(types, (F.col("event_id") % 9 + 1).cast("int")).alias("query_type"), (F.col("user_id") % 4).alias("rag"), (F.col("user_id") % 3).alias("dataset"), "value", "event_id",
        )
        .withColumn("cf_outcome", F.when(F.col("turn_id") > 0, F.when(F.col("value") * 7 - F.floor(F.col("value") * 7) < 0.6, "correct").otherwise("wrong")))
        .drop("value")
    )


def raters(spark: SparkSession, sf: str) -> DataFrame:
    """Two binary raters of documents."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "lang", "source", F.col("quality").cast("long").alias("a"), F.col("toxic").cast("long").alias("b"))


def kg_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of the relational tables: id, entity, type."""
    parts = [("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name"), ("customer", "c_name")]
    from turnlens.functions.text import slug

    frames = [table(spark, sf, t).select(slug(F.col(c)).alias("id"), F.col(c).alias("entity"), F.lit(t).alias("type")) for t, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


def kg_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Nations in regions, suppliers and customers in nations: source, target, relation."""
    from turnlens.functions.text import slug

    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    part = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(slug(F.col("n_name")).alias("source"), slug(F.col("r_name")).alias("target"), F.lit("part_of").alias("relation"))
    out = part
    for t, name, key in (("supplier", "s_name", "s_nationkey"), ("customer", "c_name", "c_nationkey")):
        rows = table(spark, sf, t)
        out = out.unionByName(rows.join(F.broadcast(nation), rows[key] == nation.n_nationkey).select(slug(F.col(name)).alias("source"), slug(F.col("n_name")).alias("target"), F.lit("located_in").alias("relation")))
    return out
