"""Aggregates over judged turns. Verdicts are derived from the views, so that they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.functions import vocab
from turnlens.plans import text_queries as tq
from turnlens.plans import views as v
from turnlens.plans import window_queries as wq
from turnlens.plans.oracle import in_, sql

_avg = lambda c, n: F.round(F.avg(c), 6).alias(n)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """The log with three flags, a null-skipping score and five slot votes."""
    e = F.col("event_id")
    return v.log(spark, sf).withColumns({
        "well_formed": e % 5 != 0, "supported": e % 3 != 0, "gold_right": F.col("outcome") == "correct",
        "score": F.when(e % 7 != 0, (e % 5) / F.lit(4.0)), "kind": F.when(e % 11 != 0, F.col("query_type")),
    })


_JUDGED = "SELECT *, event_id % 5 <> 0 AS well_formed, event_id % 3 <> 0 AS supported, outcome = 'correct' AS gold_right, CASE WHEN event_id % 7 <> 0 THEN (event_id % 5) / 4.0 END AS score, CASE WHEN event_id % 11 <> 0 THEN query_type END AS kind FROM log"


def metric_means_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Means that skip missing scores, overall and by type; a missing type is unknown."""
    rows = judged(spark, sf).withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    return rows.groupingSets([["kind"], []], "kind").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), _avg("score", "score"))


def rate_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = judged(spark, sf).withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *(_avg(F.col(c).cast("double"), c) for c in ("well_formed", "supported", "gold_right")))


def viewer_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations, turns and repeated turns of the dialogues, by a run key."""
    rows = wq.repeat_answers(spark, sf).withColumn("run", F.concat(F.lit("run"), (F.col("conv_id") % 3).cast("string")))
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("n_conv"), F.sum("n_turns").alias("n_turns"), F.sum("dup_turns").alias("dup_turns"))


def type_diversity(spark: SparkSession, sf: str) -> DataFrame:
    conv = v.log(spark, sf).groupBy("dataset", "conversation_id").agg(F.collect_set("query_type").alias("kinds"), (F.size(F.collect_set("query_type")) / F.count(F.lit(1))).alias("share"))
    return conv.groupBy("dataset").agg(F.size(F.array_distinct(F.flatten(F.collect_set("kinds")))).cast("long").alias("n_types"), _avg("share", "avg_distinct"))


def dependency_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = judged(spark, sf)
    return rows.groupBy("dataset").agg(_avg(F.col("supported").cast("double"), "doc_required_rate"), F.round(F.coalesce(F.avg(F.when(F.col("turn_id") > 0, (~F.col("well_formed")).cast("double"))), F.lit(0.0)), 6).alias("dependency_rate"))


_MAXIMS = ("quantity", "relation", "manner")


def gricean_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of each maxim over later turns, pooled, and for follow-ups alone."""
    rows = judged(spark, sf).filter("turn_id > 0")
    cols = [F.when((F.col("event_id") + i) % 6 != 0, ((F.col("event_id") + i) % 5 + 1) / F.lit(5.0)).alias(m) for i, m in enumerate(_MAXIMS)]
    long = rows.select("query_type", *cols).unpivot(["query_type"], list(_MAXIMS), "maxim", "value")
    return long.groupingSets([["maxim"], []], "maxim").agg(_avg("value", "mean"), F.round(F.avg(F.when(F.col("query_type") == "Follow-Up", F.col("value"))), 6).alias("followup_mean"), F.count("value").alias("n"))


def question_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Decomposable questions whose slots are all supported; missing votes are dropped."""
    votes = F.filter(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when((F.col("event_id") + i) % 5 != 0, (F.col("event_id") + i) % 3 != 0)), lambda x: x.isNotNull())
    rows = v.log(spark, sf).filter(F.col("query_type").isin("Comparative", "Multi-Hop")).select("query_type", votes.alias("vt")).select("query_type", F.size("vt").alias("n"), F.size(F.filter("vt", lambda x: x)).alias("ok")).filter("n > 0")
    return rows.groupingSets([["query_type"], []], "query_type").agg(F.count(F.lit(1)).alias("questions"), _avg((F.col("n") == F.col("ok")).cast("double"), "fully_grounded_rate"), F.round(F.sum("ok") / F.sum("n"), 6).alias("slot_support_rate"))


def coverage_2x2(spark: SparkSession, sf: str) -> DataFrame:
    """Answer and retrieval coverage of sub-questions, with the layer that uncovered ones point to."""
    kind = F.element_at(F.array(F.lit("core"), F.lit("background"), F.lit("follow-up")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = judged(spark, sf).select(kind.alias("kind"), F.col("gold_right").alias("ans"), F.col("well_formed").alias("ret"))
    sets = rows.groupingSets([["kind"], []], "kind").agg(F.count(F.lit(1)).alias("n"), _avg(F.col("ans").cast("double"), "m1"), _avg(F.col("ret").cast("double"), "m2"), F.count_if(~F.col("ans") & ~F.col("ret")).alias("retrieval_fail"), F.count_if(~F.col("ans") & F.col("ret")).alias("generation_fail"))
    return sets.withColumn("layer", F.when(F.col("retrieval_fail") > F.col("generation_fail"), "retrieval").when(F.col("generation_fail") > 0, "generation").otherwise("none"))


def atomic_faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    """Share of entailed claims, averaged over turns with any, by type."""
    claims, ent = F.col("event_id") % 5, F.least(F.col("event_id") % 5, F.col("event_id") % 3)
    rows = v.log(spark, sf).select("query_type", F.when(claims > 0, ent / claims).alias("f"))
    return rows.groupingSets([["query_type"], []], "query_type").agg(F.count("f").alias("n"), _avg("f", "faithfulness"))


def logprob_score(spark: SparkSession, sf: str) -> DataFrame:
    """The probability-weighted 1-5 score over digit tokens, as a share of five; null without any."""
    tok = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(F.element_at(F.array(*(F.lit(x) for x in ("1", "2", "x", "3", "4", "5", "7"))), i + 1).alias("token"), (-((F.col("event_id") + i) % 4)).cast("double").alias("logprob")))
    kept = F.filter(F.when(F.col("event_id") % 13 == 0, F.slice(tok, 3, 1)).otherwise(tok), lambda t: t["token"].rlike("^[1-5]$"))
    add = lambda f: F.aggregate(F.transform(kept, f), F.lit(0.0), lambda a, x: a + x)
    p, kp = add(lambda t: F.exp(t["logprob"])), add(lambda t: F.exp(t["logprob"]) * t["token"].cast("double"))
    return v.log(spark, sf).select("event_id", F.round(kp / F.when(p > 0, p) / 5, 6).alias("score"))


def score_spread(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rounded score 1..5 occurs; scores that never occur count 0."""
    got = judged(spark, sf).filter("score is not null").groupBy((F.floor(F.col("score") * 4 + 0.5) + 1).cast("long").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    all_ = spark.range(1, 7).withColumnRenamed("id", "score")
    return F.broadcast(all_).join(got, "score", "left").select("score", F.coalesce("n", F.lit(0)).alias("n"))


def cost_report(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, tokens and dollars by model; a model without a price has none."""
    model = F.element_at(F.array(*(F.lit(m) for m, _, _ in vocab.PRICES), F.lit("local")), (F.col("event_id") % 4 + 1).cast("int"))
    calls = v.table(spark, sf, "events").groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("event_id") % 700).alias("tokens_in"), F.sum(F.col("event_id") % 90).alias("tokens_out"))
    prices = spark.createDataFrame(vocab.PRICES, "model string, pin double, pout double")
    return calls.join(F.broadcast(prices), "model", "left").select("model", "calls", "tokens_in", "tokens_out", F.round(F.col("tokens_in") / 1e6 * F.col("pin") + F.col("tokens_out") / 1e6 * F.col("pout"), 6).alias("dollars"))


QUERIES = {f.__name__: f for f in (
    metric_means_by_type, rate_breakdown, viewer_rollup, type_diversity, dependency_rates, gricean_means, question_grounding, coverage_2x2, atomic_faithfulness, logprob_score, score_spread, cost_report,
)}

_j = lambda body: sql(body, "log", more={"j": _JUDGED})
_m = lambda c, n: f"round(avg({c}), 6) AS {n}"
SQL = {
    "metric_means_by_type": _j(f"SELECT kind, count(*) AS n, count(score) AS n_scored, {_m('score', 'score')} FROM (SELECT coalesce(kind, 'unknown') AS kind, score FROM j) GROUP BY GROUPING SETS ((kind), ())"),
    "rate_breakdown": _j(f"""SELECT coalesce(kind, 'unknown') AS kind, count(*) AS n, {_m('well_formed::INT', 'well_formed')}, {_m('supported::INT', 'supported')}, round(avg(gold_right::INT), 6) AS gold_right FROM j GROUP BY 1"""),
    "viewer_rollup": f"SELECT 'run' || conv_id % 3 AS run, count(*) AS n_conv, sum(n_turns)::BIGINT AS n_turns, sum(dup_turns)::BIGINT AS dup_turns FROM ({wq.SQL['repeat_answers']}) GROUP BY 1",
    "type_diversity": sql(f"SELECT dataset, (SELECT count(DISTINCT query_type) FROM log l WHERE l.dataset = c.dataset) AS n_types, {_m('share', 'avg_distinct')} FROM (SELECT dataset, conversation_id, count(DISTINCT query_type) / count(*) AS share FROM log GROUP BY ALL) c GROUP BY dataset", "log"),
    "dependency_rates": _j(f"SELECT dataset, {_m('supported::INT', 'doc_required_rate')}, round(coalesce(avg((NOT well_formed)::INT) FILTER (turn_id > 0), 0), 6) AS dependency_rate FROM j GROUP BY dataset"),
    "gricean_means": _j(
        "SELECT maxim, round(avg(value), 6) AS mean, round(avg(value) FILTER (query_type = 'Follow-Up'), 6) AS followup_mean, count(value) AS n FROM ("
        + " UNION ALL ".join(f"SELECT query_type, '{m}' AS maxim, CASE WHEN (event_id + {i}) % 6 <> 0 THEN ((event_id + {i}) % 5 + 1) / 5.0 END AS value FROM j WHERE turn_id > 0" for i, m in enumerate(_MAXIMS)) + ") GROUP BY GROUPING SETS ((maxim), ())"
    ),
    "question_grounding": sql(
        """SELECT query_type, count(*) AS questions, round(avg((n = ok)::INT), 6) AS fully_grounded_rate, round(sum(ok) / sum(n), 6) AS slot_support_rate FROM (
             SELECT query_type, len(list_filter([1, 2, 3, 4], lambda i: (event_id + i) % 5 <> 0)) AS n, len(list_filter([1, 2, 3, 4], lambda i: (event_id + i) % 5 <> 0 AND (event_id + i) % 3 <> 0)) AS ok FROM log WHERE query_type IN ('Comparative', 'Multi-Hop'))
           WHERE n > 0 GROUP BY GROUPING SETS ((query_type), ())""",
        "log",
    ),
    "coverage_2x2": _j(
        """SELECT *, CASE WHEN retrieval_fail > generation_fail THEN 'retrieval' WHEN generation_fail > 0 THEN 'generation' ELSE 'none' END AS layer FROM (
             SELECT kind, count(*) AS n, round(avg(a::INT), 6) AS m1, round(avg(r::INT), 6) AS m2, count(*) FILTER (NOT a AND NOT r) AS retrieval_fail, count(*) FILTER (NOT a AND r) AS generation_fail
             FROM (SELECT (['core', 'background', 'follow-up'])[event_id % 3 + 1] AS kind, gold_right AS a, well_formed AS r FROM j) GROUP BY GROUPING SETS ((kind), ()))"""
    ),
    "atomic_faithfulness": sql("SELECT query_type, count(f) AS n, round(avg(f), 6) AS faithfulness FROM (SELECT query_type, CASE WHEN event_id % 5 > 0 THEN least(event_id % 5, event_id % 3) / (event_id % 5) END AS f FROM log) GROUP BY GROUPING SETS ((query_type), ())", "log"),
    "logprob_score": sql(
        "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE round((" + " + ".join(f"{d} * exp(-((event_id + {i}) % 4)::DOUBLE)" for i, d in ((0, 1), (1, 2), (3, 3), (4, 4), (5, 5))) + ") / (" + " + ".join(f"exp(-((event_id + {i}) % 4)::DOUBLE)" for i in (0, 1, 3, 4, 5)) + ") / 5, 6) END AS score FROM log", "log"
    ),
    "score_spread": _j("SELECT s.s AS score, coalesce(n, 0) AS n FROM range(1, 7) s(s) LEFT JOIN (SELECT floor(score * 4 + 0.5)::BIGINT + 1 AS k, count(*) AS n FROM j WHERE score IS NOT NULL GROUP BY 1) g ON g.k = s.s"),
    "cost_report": f"""SELECT model, calls, tokens_in, tokens_out, round(tokens_in / 1e6 * pin + tokens_out / 1e6 * pout, 6) AS dollars FROM (
        SELECT ([{', '.join(f"'{m}'" for m, _, _ in vocab.PRICES)}, 'local'])[event_id % 4 + 1] AS model, count(*) AS calls, sum(event_id % 700)::BIGINT AS tokens_in, sum(event_id % 90)::BIGINT AS tokens_out FROM events GROUP BY 1)
        LEFT JOIN (VALUES {', '.join(f"('{m}', {a}, {b})" for m, a, b in vocab.PRICES)}) p(model, pin, pout) USING (model)""",
}
