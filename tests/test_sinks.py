"""Sinks, models behind providers, and systems by name."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from turnlens.operators import graph, systems
from turnlens.plans import views
from turnlens.providers import model
from turnlens.sources import sinks


def chunks(spark):
    return views.chunks(spark, f"{DATA}/sf0.001").limit(60)


def test_graph_is_stored_without_loss(spark, tmp_path):
    rows = chunks(spark)
    found = graph.extract(rows)
    edges = graph.edges_of(found)
    mentions = graph.mentions_of(found, edges)
    nodes = mentions.select(F.col("node_id").alias("id")).distinct()
    sinks.write_graph(nodes, mentions, edges, str(tmp_path / "g"))
    n, m, e = sinks.read_graph(spark, str(tmp_path / "g"))
    assert (n.count(), m.count(), e.count()) == (nodes.count(), mentions.count(), edges.count()) and e.count() > 0
    _, _, c = sinks.read_graph(spark, str(tmp_path / "g"), collapsed=True)
    assert c.agg(F.sum("weight")).first()[0] == e.count() and "chunk_id" not in c.columns


def test_embeddings_are_encoded_once(spark, tmp_path):
    path, rows = str(tmp_path / "e"), spark.createDataFrame([(1, "one two"), (2, "three"), (3, "one two")], "id long, text string")
    first = {r["id"]: r["embedding"] for r in sinks.embedded(rows, model.encoder(8), "h8", path).collect()}
    assert first[1] == first[3] != first[2] and len(first[1]) == 8
    broken = model.encoder(8, lambda texts: 1 / 0)
    more = rows.unionByName(spark.createDataFrame([(4, "new")], "id long, text string"))
    again = {r["id"]: r["embedding"] for r in sinks.embedded(more, broken, "h8", path).collect()}
    assert again == first | {4: None} and spark.read.parquet(path).count() == 2
    assert abs(sum(x * x for x in first[2]) - 1) < 1e-9 and model.hashed_vector("") == [0.0] * 64


def test_seeds_are_shared(spark, tmp_path):
    path = str(tmp_path / "s")
    seeds = lambda qs: spark.createDataFrame([("d", "r", 10, 1, i, q) for i, q in qs], "dataset string, rag string, chunks int, seed int, seed_id long, question string")
    sinks.shared_seeds(seeds([(1, "a"), (2, "b")]), path)
    assert {(r["seed_id"], r["question"]) for r in sinks.shared_seeds(seeds([(2, "other"), (3, "c")]), path).collect()} == {(2, "b"), (3, "c")}


def test_reports_and_review(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "id long, text string")
    sinks.write_reports({"summary": rows, "scores": rows}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "scores")).first()["text"] == "x"
    sinks.write_review(rows, {"grounding": "not in the evidence"}, {"seed": "1"}, str(tmp_path / "v"))
    assert json.loads(spark.read.text(str(tmp_path / "v" / "cases")).first()[0]) == {"id": 1, "text": "x"}
    assert {r["part"] for r in spark.read.json(str(tmp_path / "v" / "about")).collect()} == {"guide", "meta"}


def test_calls_retry_and_count(spark):
    waits, replies = [], iter(["not json", '{"ok": 1}'])
    got = model.call(lambda s, p: (next(replies), 10, 2), "s", "p", wait=waits.append)
    assert got == {"reply": {"ok": 1}, "tokens_in": 20, "tokens_out": 4} and waits == [1.0]
    assert model.call(lambda s, p: 1 / 0, "s", "p", wait=waits.append)["reply"] is None and waits == [1.0, 1.0, 2.0]
    rows = spark.createDataFrame([("a" * 300,), (None,)], "text string")
    assert [r[0] for r in rows.select(F.length(model.cut("answer", F.col("text")))).collect()] == [200, 0]
    judged = model.asked(lambda s, p: ('{"v": 1}', 1000, 100), {"t": "sys"}).evaluate("t", rows)
    spent = model.usage(judged, "gpt-4o-mini").first()
    assert (spent["calls"], spent["tokens_in"], spent["dollars"]) == (2, 2000, round(2000 * 0.15e-6 + 200 * 0.6e-6, 6))


def test_rubric_and_extractor(spark):
    rows = spark.createDataFrame([(1, "Alpha Beta met Gamma.")], "chunk_id long, text string")
    scored = model.Rubric().add("short", lambda: (F.length("text") < 100).cast("double")).scored(rows)
    assert scored.first()["short"] == 1.0
    own = model.Python(lambda task, rows: [json.dumps({"ents": ["X", "Y"], "pairs": [{"a": "X", "b": "Y"}]}) for _ in rows])
    assert model.extracted(rows, own).first()["ents"] == ["X", "Y"]
    fails = model.Python(lambda task, rows: 1 / 0)
    assert model.extracted(rows, fails).first()["ents"] == model.extracted(rows).first()["ents"] != []


@pytest.mark.parametrize("name", ["vector", "longrag", "mock", "selfrag", "crag", "graph", "hippo"])
def test_systems_answer_every_question(spark, name):
    seeds = views.bench(spark, f"{DATA}/sf0.001").limit(6).select(F.col("item_id").alias("qid"), "question", F.col("question").alias("query"))
    got = systems.connect(name)(seeds, chunks(spark)).collect()
    assert len(got) == 6 and all(r["answer"] for r in got)
    assert all([d["rank"] for d in r["docs"]] == list(range(1, len(r["docs"]) + 1)) for r in got if r["docs"])


def test_external_index_is_a_placeholder(spark):
    with pytest.raises(NotImplementedError):
        systems.connect("pageindex")(None, None)


def test_rewrites_fall_back_to_the_question(spark):
    from turnlens.providers import base

    rows = spark.createDataFrame([(1, "What is it?", "user: the mill"), (2, "And then?", ""), (3, "fails", "x"), (4, "blank", "x")], "k long, question string, history string")
    made = base.Rule({"self_contained": F.when(F.col("question") == "blank", " ").when(F.col("question") != "fails", F.concat(F.lit(" about: "), "question"))})
    got = {r["k"]: r["rewritten"] for r in model.rewritten(rows, "self_contained", made).collect()}
    assert got == {1: "about: What is it?", 2: "And then?", 3: "fails", 4: "blank"}
    assert {r["k"]: r["rewritten"] for r in model.rewritten(rows, "refine").collect()} == {1: "What is it?", 2: "And then?", 3: "fails", 4: "blank"}
    with pytest.raises(ValueError):
        model.rewritten(rows, "other")


def test_queries_without_tokens_get_the_first_chunks(spark):
    units = spark.createDataFrame([(i, 0, i, f"number {i}") for i in range(9)], "chunk_id long, doc_id long, pos long, text string")
    asked = spark.createDataFrame([(1, "…", "…"), (2, "number", "number 5")], "qid long, question string, query string")
    got = {r["qid"]: [(d["chunk_id"], d["score"] is None) for d in r["docs"]] for r in systems.connect("vector")(asked, units, k=3).collect()}
    assert got[1] == [(0, True), (1, True), (2, True)] and got[2][0] == (5, False)
