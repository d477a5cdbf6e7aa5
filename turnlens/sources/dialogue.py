"""Human dialogues: nested messages to question-answer turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIALOGUE = (
    "domain string, messages array<struct<speaker:string,text:string,original_text:string,enrichments:string,"
    "contexts:array<struct<document_id:string,score:string,text:string,title:string>>>>"
)


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array (or lines) of conversations."""
    return spark.read.schema(DIALOGUE).option("multiLine", True).json(path)


def first_label(enrichments: Column, name: str) -> Column:
    """The first label of a kind in a dict, given as JSON or as its Python text; null if malformed."""
    return F.nullif(F.regexp_extract(enrichments, r"""['"]""" + name + r"""['"]\s*:\s*\[?\s*['"]([^'"]*)['"]""", 1), F.lit(""))


def number(text: Column) -> Column:
    """A number to six digits, null where there is none."""
    return F.round(text.try_cast("double"), 6)


def pairs(dialogues: DataFrame, key: str, abstentions: tuple[str, ...] = (), keep_shown: bool = True) -> DataFrame:
    """(key, turn_id, question, answer, labels, contexts): agent messages right after a user's.

    A canned abstention falls back to its original text, or else to what was
    shown (``keep_shown``) or goes. Blank contexts go but ranks stay those of
    the original positions. Turns without question or answer go.
    """
    m = F.col("messages")
    shown = lambda x: F.when(F.lower(F.trim(x["text"])).isin(*abstentions), F.coalesce(x["original_text"], x["text"] if keep_shown else F.lit(None).cast("string"))).otherwise(x["text"]) if abstentions else x["text"]
    paired = F.filter(F.transform(m, lambda x, i: F.struct(F.when(i > 0, F.get(m, i - 1)).alias("u"), x.alias("a"), i.alias("i"))), lambda p: (p["a"]["speaker"] == "agent") & (p["u"]["speaker"] == "user") & (F.trim(p["u"]["text"]) != "") & (F.trim(shown(p["a"])) != ""))
    docs = lambda x: F.filter(F.transform(x["contexts"], lambda c, i: F.struct(c["document_id"].alias("doc_id"), (i + 1).alias("rank"), number(c["score"]).alias("score"), c["text"].alias("text"))), lambda d: F.trim(d["text"]) != "")
    rows = dialogues.select(key, "domain", F.posexplode(paired).alias("turn_id", "p"))
    return rows.select(
        key, "domain", "turn_id", F.trim("p.u.text").alias("question"), F.trim(shown(F.col("p.a"))).alias("answer"),
        *(first_label(F.col("p.u.enrichments"), n).alias(a) for n, a in (("Question Type", "question_type"), ("Answerability", "answerability"), ("Multi-Turn", "multi_turn"))), docs(F.col("p.a")).alias("contexts"),
    )
