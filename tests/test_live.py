"""Providers, and the stream against the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import DATA
from turnlens.operators import control
from turnlens.plans import views
from turnlens.providers import base
from turnlens.streaming import live


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    outcome = F.when(F.col("event_type").isin("view", "click"), "correct").when(F.col("event_type") == "purchase", "wrong").when(F.col("event_type") == "error", "hallucinated").otherwise("abstained")
    rows = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").select(F.col("user_id").alias("conversation_id"), "ts", "event_id", outcome.alias("outcome"))
    rows.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    q = live.controller(stream).writeStream.outputMode("append").format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r[0], r[1], r[2]) for r in control.fold(views.log(spark, f"{DATA}/sf0.001")).collect()}
    assert {(r["conversation_id"], r["turn_id"], r["next_type"]) for r in spark.table("steps").collect()} == want
    q = live.profile(stream).writeStream.outputMode("complete").format("memory").queryName("profile").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("profile").agg(F.sum("n")).first()[0] == rows.count()


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, None, "c")], "k long, gold string, answer string")
    same = F.col("gold") == F.col("answer")
    got = base.judged(rows, base.Rule({"same": same.cast("string")}), "same", ["gold", "answer"], F.lit("none"))
    assert {r["k"]: r["verdict"] for r in got.collect()} == {1: "false", 2: "false", 3: "none"}
    calls = base.Python(lambda task, items: [f"{task}:{x['gold']}" for x in items])
    assert {r["k"]: r["verdict"] for r in base.judged(rows, calls, "t", ["gold"]).collect()} == {1: "t:a", 2: "t:a", 3: "t:None"}
    broken = base.Python(lambda task, items: 1 / 0)
    assert {r["verdict"] for r in base.judged(rows, broken, "t", ["gold"], F.lit("rule")).collect()} == {"rule"}
    stored = rows.limit(1).select(F.lit("t").alias("task"), base.payload_hash(["gold"]).alias("payload_hash"), F.lit("yes").alias("verdict"))
    assert {r["k"]: r["verdict"] for r in base.judged(rows, base.Replay(stored), "t", ["gold"]).collect()} == {1: "yes", 2: "yes", 3: None}
