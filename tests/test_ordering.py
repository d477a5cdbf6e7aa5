from __future__ import annotations

from pyspark.sql import functions as F

from turnlens.operators import ordering, retrieval


def test_numbers_are_consecutive_in_order(spark):
    rows = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1009).alias("k"))
    got = ordering.numbered(rows, "k").orderBy("k").collect()
    assert [r["rn"] for r in got] == list(range(1000))
    assert ordering.numbered(rows.limit(0), "k").count() == 0


def test_dense_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    vecs = spark.range(60).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * (i + 1)) for i in range(4))).alias("emb"))
    asked = vecs.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("emb").alias("qemb"))
    got = {(r["qid"], r["rank"]): r["vec_id"] for r in retrieval.dense_topk(asked, vecs, 3).collect()}
    rows = {r["vec_id"]: r["emb"] for r in vecs.collect()}
    for q in range(0, 60, 5):
        best = sorted(rows, key=lambda u: (-round(sum(a * b for a, b in zip(rows[q], rows[u], strict=True)), 9), u))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == best


def test_dense_search_writes_no_pairs(spark, monkeypatch):
    """Ties, copies and more vectors than a tile: the ranks of all pairs, from k rows a query and task."""
    monkeypatch.setattr(retrieval.scoring, "TILE_VECTORS", 16)
    monkeypatch.setattr(retrieval.scoring, "TILE_QUERIES", 8)
    vecs = spark.range(200).select(F.col("id").alias("vec_id"), F.array(*(F.sin((F.col("id") % 150) * (i + 1)) for i in range(4))).alias("emb")).repartition(3)
    asked = vecs.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("qid"), F.col("emb").alias("qemb"))
    plan = []
    monkeypatch.setattr(retrieval, "kept", lambda d: plan.append(d._jdf.queryExecution().optimizedPlan().toString()) or d.localCheckpoint())
    got = {(r["qid"], r["rank"]): r["vec_id"] for r in retrieval.dense_topk(asked, vecs, 3).collect()}
    rows = {r["vec_id"]: r["emb"] for r in vecs.collect()}
    for q in range(0, 200, 9):
        assert [got[q, r] for r in (1, 2, 3)] == sorted(rows, key=lambda u: (-round(sum(a * b for a, b in zip(rows[q], rows[u], strict=True)), 9), u))[:3]
    assert plan and "Join" not in plan[0]
