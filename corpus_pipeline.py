"""From raw documents to a tokenised training mix.

Stages: toxic documents go; of exact copies the one with the largest id
stays; of each group of near duplicates the one with the least id stays; the
rest is mixed to the target weights (a document stands once for every time it
is taken); what is left is encoded. Each stage returns all columns of
``documents``, the last the token ids.

The first stage learns from ``labels``, and the third is a similarity join, so
SQL cannot express the rows of :func:`run`; tests hold every stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnlens.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from turnlens.llm.common import cut, table
from turnlens.llm.entry import byte_bpe


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the packed ids and the hashes of the ids and of the decoded bytes."""
    rows = bpe.encode(docs, byte_bpe())
    return bpe.digests(rows, keep=["ids"])


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard", without_near_duplicates),
    ("mix_sources", mixed),
    ("byte_bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each computed once into the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
