"""Tables that a run writes and later runs read: graphs, trees, embeddings, shared seeds, reports, review files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.operators import graph, tree
from turnlens.providers.base import Provider, judged

MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing was stored yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # any other failure is the caller's
        if not any(m in str(e) for m in MISSING):
            raise
        return None


def write_graph(nodes: DataFrame, mentions: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph without loss: parallel edges keep their chunks."""
    for name, df in (("nodes", nodes), ("mentions", mentions), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, collapsed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, mentions and edges; ``collapsed`` has parallel edges as one with a weight, and no chunks."""
    nodes, mentions, edges = (spark.read.parquet(f"{path}/{n}") for n in ("nodes", "mentions", "edges"))
    return nodes, mentions, graph.collapse(edges) if collapsed else edges


def embedded(texts: DataFrame, provider: Provider, model: str, path: str, text: str = "text") -> DataFrame:
    """``texts`` with embedding: read from the index at ``path``, encoded and appended where it has no row.

    The index is keyed by (model, sha1 of the text), so a changed corpus reuses what it still shares.
    """
    spark = texts.sparkSession
    wanted = texts.select(text).distinct().withColumn("sha1", F.sha1(F.col(text)))
    there = stored(spark, path)
    have = there.filter(F.col("model") == model).select("sha1", "embedding") if there is not None else None
    fresh = wanted if have is None else wanted.join(have, "sha1", "left_anti")
    made = judged(fresh.select(F.col(text).alias("text"), "sha1"), provider, "encode", ["text"]).filter("verdict is not null")
    made.select(F.lit(model).alias("model"), "sha1", F.from_json("verdict", "array<double>").alias("embedding")).write.mode("append").partitionBy("model").parquet(path)
    index = spark.read.parquet(path).filter(F.col("model") == model).dropDuplicates(["sha1"]).select("sha1", "embedding")
    return texts.withColumn("sha1", F.sha1(F.col(text))).join(index, "sha1", "left").drop("sha1")


def shared_seeds(seeds: DataFrame, path: str, keys: tuple[str, ...] = ("dataset", "rag", "chunks", "seed")) -> DataFrame:
    """Grounded questions of seeds, the same for all methods: stored ones stay, new ones are appended."""
    there = stored(seeds.sparkSession, path)
    fresh = seeds if there is None else seeds.join(there.select(*keys, "seed_id"), [*keys, "seed_id"], "left_anti")
    fresh.select(*keys, "seed_id", "question").write.mode("append").parquet(path)
    grounded = seeds.sparkSession.read.parquet(path)
    return seeds.drop("question").join(grounded, [*keys, "seed_id"])


def stored_tree(units: DataFrame, path: str, **options: object) -> DataFrame:
    """The tree of summaries over ``units``: read from ``path`` if it is there, else built and written."""
    there = stored(units.sparkSession, path)
    if there is None:
        tree.build(units, **options).write.parquet(path)
        there = units.sparkSession.read.parquet(path)
    return there


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """A JSON report for each name (summary, failure types, grounding, similarity, quality, scores)."""
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_review(cases: DataFrame, guide: dict[str, str], meta: dict[str, str], path: str) -> None:
    """Cases for human review, one JSON row each, with the guide of labels and how they were sampled beside them."""
    cases.select(F.to_json(F.struct(*cases.columns)).alias("value")).write.mode("overwrite").text(f"{path}/cases")
    rows = [("guide", k, v) for k, v in guide.items()] + [("meta", k, v) for k, v in meta.items()]
    cases.sparkSession.createDataFrame(rows, "part string, name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/about")
