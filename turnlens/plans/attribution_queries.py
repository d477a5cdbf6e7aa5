"""Failure summaries, attribution scores, agreement of raters and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.functions import vocab
from turnlens.plans import text_queries as tq
from turnlens.plans import views as v
from turnlens.plans.oracle import in_, sql


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Four attribution methods over the log as injected cases (synthetic, for volume): method, seed, case_id, truth, pred.

    Static methods never answer Conversation; seed 4 never fires it.
    """
    cat = lambda x: F.element_at(F.array(*(F.lit(c) for c in vocab.CATEGORIES)), (x % 3 + 1).cast("int"))
    cases = v.table(spark, sf, "events").select(F.col("event_id").alias("case_id"), (F.col("user_id") % 5).alias("seed"), cat(F.col("event_id")).alias("truth"))
    cases = cases.filter("not (seed = 4 and truth = 'Conversation')")
    methods = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("m"), F.lit(n).alias("method")) for i, n in enumerate(vocab.METHODS)))).alias("x")
    rows = cases.select("*", methods).select("case_id", "seed", "truth", "x.method", "x.m")
    raw = F.when((F.col("case_id") * 7 + F.col("m") * 3) % 10 < F.col("m") + 4, F.col("truth")).otherwise(cat(F.col("case_id") + F.col("m")))
    return rows.select("case_id", "seed", "truth", "method", F.when((F.col("m") < 4) & (raw == "Conversation"), "Retrieval").otherwise(raw).alias("pred"))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return tq.failure_classify(spark, sf).join(v.log(spark, sf).select("conversation_id", "turn_id", "rag", "dataset", "query_type"), ["conversation_id", "turn_id"])


def failure_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Failed turns by type, layer, cause and question type in one pass over them."""
    dims = ["failure_type", "layer", "cause", "query_type"]
    sets = classified(spark, sf).groupingSets([[d] for d in dims], *dims).agg(F.count(F.lit(1)).alias("n"))
    name = F.coalesce(*(F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims))
    return sets.select(name.alias("dimension"), F.coalesce(*dims).alias("value"), "n")


def label_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their label where one is given."""
    lab = v.table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, " toxic ").otherwise("").alias("label"))
    docs = v.table(spark, sf, "documents").select("doc_id", "lang")
    label = F.trim("label")
    return docs.join(lab, "doc_id", "left").select("doc_id", "lang", F.coalesce(F.when(label != "", label), F.lit("pending")).alias("label"))


def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of the (dataset, rag, seed) matrix that have no result yet."""
    jobs = spark.range(3).select(F.col("id").alias("dataset")).select("dataset", F.explode(F.expr("sequence(0L, 3L)")).alias("rag")).select("*", F.explode(F.expr("sequence(0L, 9L)")).alias("seed"))
    done = v.log(spark, sf).filter("outcome = 'hallucinated' and turn_id < 4").select("dataset", "rag", (F.col("event_id") % 10).alias("seed")).distinct()
    return jobs.join(done, ["dataset", "rag", "seed"], "left_anti")


def fired_built(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).filter(F.col("method") == vocab.METHODS[0])
    return rows.groupBy("seed", "truth").agg(F.count_if(F.col("case_id") % 4 != 0).alias("fired"), F.count(F.lit(1)).alias("built"))


def early_stop_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each dataset in seeded order until ten were verified: where that was, and what came before."""
    rows = v.log(spark, sf).select("dataset", "event_id", (F.col("outcome") != "abstained").alias("verified"), F.md5(F.concat(F.lit("7|"), F.col("event_id").cast("string"))).alias("key"))
    tenth = rows.filter("verified").withColumn("r", F.row_number().over(Window.partitionBy("dataset").orderBy("key"))).filter("r <= 10").groupBy("dataset").agg(F.max("key").alias("stop"))
    seen = rows.join(F.broadcast(tenth), "dataset").filter("key <= stop")  # one row a dataset
    return seen.groupBy("dataset").agg(F.count_if("verified").alias("n_verified"), F.count_if(~F.col("verified")).alias("n_skipped"))


def attribution_score(spark: SparkSession, sf: str) -> DataFrame:
    ok = (F.col("pred") == F.col("truth")).cast("long")
    return predictions(spark, sf).groupingSets([["method", "truth"], ["method"]], "method", "truth").agg(F.sum(ok).alias("k"), F.count(F.lit(1)).alias("n"), F.round(F.sum(ok) / F.count(F.lit(1)), 6).alias("accuracy"))


def confusion_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five most common confusions of each method; names break ties."""
    wrong = predictions(spark, sf).filter("pred <> truth").groupBy("method", F.concat("truth", F.lit("->"), "pred").alias("confusion")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("method").orderBy(F.desc("n"), "confusion")
    return wrong.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5")


def per_seed(spark: SparkSession, sf: str) -> DataFrame:
    """(method, seed): accuracy of each category that fired, overall, and their unweighted means."""
    rows = predictions(spark, sf).groupBy("method", "seed").agg(
        F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("micro"),
        *(F.avg(F.when(F.col("truth") == c, (F.col("pred") == F.col("truth")).cast("double"))).alias(c.lower()) for c in vocab.CATEGORIES),
    )
    mean = lambda cols: F.aggregate(F.filter(F.array(*cols), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x) / F.size(F.filter(F.array(*cols), lambda x: x.isNotNull()))
    return rows.withColumn("macro", mean(["retrieval", "generation", "conversation"])).withColumn("shared", mean(["retrieval", "generation"]))


def macro_micro_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and population deviation over seeds of each metric; categories count where they fired."""
    long = per_seed(spark, sf).unpivot(["method", "seed"], ["micro", "macro", "shared", "retrieval", "generation", "conversation"], "metric", "value").filter("value is not null")
    return long.groupBy("method", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"))


def _best_static(seeds: DataFrame) -> DataFrame:
    means = seeds.filter(F.col("method") != vocab.METHODS[-1]).groupBy("method").agg(F.avg("shared").alias("s"))
    return means.agg(F.max_by("method", F.struct(F.round("s", 9), -F.ascii("method"))).alias("method"))


def fair_macro(spark: SparkSession, sf: str) -> DataFrame:
    """The dynamic method against the best static one on the categories both can name."""
    seeds = per_seed(spark, sf)
    stat = lambda df, p: df.agg(*(F.avg(c).alias(f"{p}_{c}") for c in ("shared", "macro", "conversation")))
    best = _best_static(seeds)
    dyn = stat(seeds.filter(F.col("method") == vocab.METHODS[-1]), "dyn")
    base = seeds.join(F.broadcast(best), "method").groupBy("method").agg(*(F.avg(c).alias(f"base_{c}") for c in ("shared", "macro", "conversation")))
    gap3 = F.col("dyn_macro") - F.col("base_macro")
    r = lambda c, n: F.round(c, 6).alias(n)
    return base.crossJoin(dyn).select(  # one row each
        F.col("method").alias("best_static"), r(F.col("dyn_shared") - F.col("base_shared"), "gap_shared"), r(gap3, "gap_3class"), r(F.col("dyn_conversation"), "dyn_conversation"), r(F.col("dyn_conversation") / 3 / F.when(gap3 != 0, gap3), "conversation_share")
    )


def paired_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """By seed: the dynamic method less the best static one, joined on the seed."""
    seeds = per_seed(spark, sf)
    base = seeds.join(F.broadcast(_best_static(seeds)), "method").select("seed", *(F.col(c).alias(f"b_{c}") for c in ("shared", "retrieval", "generation")))
    dyn = seeds.filter(F.col("method") == vocab.METHODS[-1])
    return dyn.join(base, "seed").select("seed", *(F.round(F.col(c) - F.col(f"b_{c}"), 6).alias(c) for c in ("shared", "retrieval", "generation")))


def kappa(rows: DataFrame, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """Cohen's kappa of two raters (columns a, b) for every grouping set, from one pass.

    Null for fewer than two items and for expected agreement of one; 1 where
    both raters know a single label.
    """
    cells = rows.groupingSets([[*s, "a", "b"] for s in sets], *keys, "a", "b").agg(F.count(F.lit(1)).alias("c"), F.grouping_id().alias("g"))
    whole = cells.groupBy("g", *keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"), F.size(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("labels"))
    side = lambda s: cells.groupBy("g", *keys, F.col(s).alias("l")).agg(F.sum("c").alias(f"n{s}"))
    on = lambda x, y, more=(): [x[k].eqNullSafe(y[k]) for k in ("g", *keys, *more)]
    one, two = side("a"), side("b")
    meet = one.join(two, on(one, two, ("l",))).select(one["g"], *(one[k] for k in keys), (F.col("na") * F.col("nb")).alias("x"))
    pe = meet.groupBy("g", *keys).agg(F.sum("x").alias("x"))
    joined = whole.join(pe, on(whole, pe), "left").select(*(whole[k] for k in keys), "n", "same", "labels", F.coalesce("x", F.lit(0)).alias("x"))
    po, ex = F.col("same") / F.col("n"), F.col("x") / (F.col("n") * F.col("n"))
    value = F.when(F.col("n") < 2, None).when(F.col("labels") < 2, 1.0).when(ex >= 1, None).otherwise((po - ex) / F.when(ex < 1, 1 - ex))
    return joined.select(*keys, "n", F.round(po, 6).alias("agreement"), F.round(value, 6).alias("kappa"))


def cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return kappa(v.raters(spark, sf), [["lang"], []], ["lang"])


def annotation_score(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed cases by language: pending, invalid and scored labels, with type and layer accuracy."""
    rows = v.raters(spark, sf)
    types = F.array(*(F.lit(x) for x in [*vocab.FAILURE_LAYERS, "not_a_failure", "", "bogus"]))
    truth, pred = F.element_at(types, (F.col("doc_id") % 9 + 1).cast("int")), F.element_at(types, ((F.col("doc_id") + F.col("a") * 5 + F.col("b")) % 6 + 1).cast("int"))
    layer = lambda c: F.create_map(*(F.lit(x) for kv in {**vocab.FAILURE_LAYERS, "not_a_failure": "none"}.items() for x in kv))[c]
    made = rows.select("lang", truth.alias("t"), pred.alias("p")).withColumns({"tl": layer(F.col("t")), "pl": layer(F.col("p"))})
    valid = F.coalesce(F.col("tl").isNotNull(), F.lit(False))
    share = lambda c: F.round(F.count_if(valid & c) / F.count_if(valid), 6)
    return made.groupingSets([["lang"], []], "lang").agg(
        F.count_if(F.col("t") == "").alias("pending"), F.count_if((F.col("t") != "") & ~valid).alias("invalid"), F.count_if(valid).alias("n"), share(F.col("t") == F.col("p")).alias("type_accuracy"), share(F.col("tl") == F.col("pl")).alias("layer_accuracy")
    )


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Five documents of each language in seeded order."""
    key = F.md5(F.concat(F.lit("0|"), F.col("doc_id").cast("string")))
    rows = v.table(spark, sf, "documents").select("lang", "doc_id", key.alias("k"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("k"))).filter("r <= 5").select("lang", "doc_id", F.col("r").cast("long").alias("pick"))


def failure_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations, failed turns and types of failure of each run; conversations without any count too."""
    convs = v.log(spark, sf).groupBy("rag", "dataset").agg(F.count_distinct("conversation_id").alias("convs"))
    by = classified(spark, sf).groupBy("rag", "dataset").agg(F.count(F.lit(1)).alias("failed"), *(F.count_if(F.col("failure_type") == x).alias(x) for x in ("grounding", "retrieval", "knowledge_boundary")), F.count_if(F.col("layer") == "generation").alias("generation_layer"))
    return convs.join(by, ["rag", "dataset"], "left").na.fill(0)


QUERIES = {f.__name__: f for f in (
    failure_grouping_sets, label_merge, resume_antijoin, fired_built, early_stop_sample, attribution_score, confusion_topk, macro_micro_seeds, fair_macro, paired_deltas, cohen_kappa, annotation_score, stratified_sample, failure_rollup,
)}

_CATS = "['Retrieval', 'Generation', 'Conversation']"
_PREDS = f"""SELECT case_id, seed, truth, method, CASE WHEN m < 4 AND raw = 'Conversation' THEN 'Retrieval' ELSE raw END AS pred FROM (
      SELECT *, CASE WHEN (case_id * 7 + m * 3) % 10 < m + 4 THEN truth ELSE ({_CATS})[(case_id + m) % 3 + 1] END AS raw FROM (
        SELECT event_id AS case_id, user_id % 5 AS seed, ({_CATS})[event_id % 3 + 1] AS truth FROM events), (VALUES {', '.join(f"({i + 1}, '{m}')" for i, m in enumerate(vocab.METHODS))}) ms(m, method)
      WHERE NOT (seed = 4 AND truth = 'Conversation'))"""
_ACC = lambda c: f"avg((pred = truth)::INT) FILTER (truth = '{c}') AS {c.lower()}"
_PER_SEED = f"""SELECT *, (coalesce(retrieval, 0) + coalesce(generation, 0) + coalesce(conversation, 0)) / ((retrieval IS NOT NULL)::INT + (generation IS NOT NULL)::INT + (conversation IS NOT NULL)::INT) AS macro,
      (coalesce(retrieval, 0) + coalesce(generation, 0)) / ((retrieval IS NOT NULL)::INT + (generation IS NOT NULL)::INT) AS shared
    FROM (SELECT method, seed, avg((pred = truth)::INT) AS micro, {', '.join(map(_ACC, vocab.CATEGORIES))} FROM ({_PREDS}) GROUP BY method, seed)"""
_BEST = f"(SELECT method FROM ps WHERE method <> '{vocab.METHODS[-1]}' GROUP BY method ORDER BY round(avg(shared), 9) DESC, method LIMIT 1)"
_CLS = f"SELECT * FROM ({tq._CLASSIFIED}) JOIN {tq._LAYERS} USING (failure_type)"
_TYPES = "[" + ", ".join(f"'{x}'" for x in [*vocab.FAILURE_LAYERS, "not_a_failure", "", "bogus"]) + "]"
_LAYER = lambda c: f"CASE WHEN {c} IN {in_(tuple(k for k, x in vocab.FAILURE_LAYERS.items() if x == 'retrieval'))} THEN 'retrieval' WHEN {c} IN ('grounding', 'response_coverage') THEN 'generation' WHEN {c} = 'not_a_failure' THEN 'none' END"
SQL = {
    "failure_grouping_sets": sql(" UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM c GROUP BY {d}" for d in ("failure_type", "layer", "cause", "query_type")), "log", more={"c": _CLS}),
    "label_merge": "SELECT doc_id, lang, coalesce(nullif(trim(CASE WHEN toxic = 1 THEN ' toxic ' ELSE '' END), ''), 'pending') AS label FROM documents LEFT JOIN labels USING (doc_id)",
    "resume_antijoin": sql("SELECT d.d AS dataset, r.r AS rag, s.s AS seed FROM range(3) d(d), range(4) r(r), range(10) s(s) WHERE NOT EXISTS (SELECT 1 FROM log WHERE outcome = 'hallucinated' AND turn_id < 4 AND dataset = d.d AND rag = r.r AND event_id % 10 = s.s)", "log"),
    "fired_built": f"SELECT seed, truth, count(*) FILTER (case_id % 4 <> 0) AS fired, count(*) AS built FROM ({_PREDS}) WHERE method = '{vocab.METHODS[0]}' GROUP BY seed, truth",
    "early_stop_sample": sql(
        """SELECT dataset, count(*) FILTER (verified) AS n_verified, count(*) FILTER (NOT verified) AS n_skipped FROM (
             SELECT *, coalesce(sum(verified::INT) OVER (PARTITION BY dataset ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT dataset, outcome <> 'abstained' AS verified, md5('7|' || event_id) AS key FROM log))
           WHERE before < 10 GROUP BY dataset""",
        "log",
    ),
    "attribution_score": f"SELECT method, truth, sum((pred = truth)::INT)::BIGINT AS k, count(*) AS n, round(avg((pred = truth)::INT), 6) AS accuracy FROM ({_PREDS}) GROUP BY GROUPING SETS ((method, truth), (method))",
    "confusion_topk": f"SELECT * FROM (SELECT method, confusion, n, row_number() OVER (PARTITION BY method ORDER BY n DESC, confusion) AS rank FROM (SELECT method, truth || '->' || pred AS confusion, count(*) AS n FROM ({_PREDS}) WHERE pred <> truth GROUP BY ALL)) WHERE rank <= 5",
    "macro_micro_seeds": sql(
        "SELECT method, metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM (UNPIVOT ps ON micro, macro, shared, retrieval, generation, conversation INTO NAME metric VALUE value) GROUP BY method, metric", more={"ps": _PER_SEED}
    ),
    "fair_macro": sql(
        f"""SELECT method AS best_static, round(ds - bs, 6) AS gap_shared, round(dm - bm, 6) AS gap_3class, round(dc, 6) AS dyn_conversation, round(dc / 3 / nullif(dm - bm, 0), 6) AS conversation_share FROM
              (SELECT method, avg(shared) AS bs, avg(macro) AS bm FROM ps WHERE method = {_BEST} GROUP BY method), (SELECT avg(shared) AS ds, avg(macro) AS dm, avg(conversation) AS dc FROM ps WHERE method = '{vocab.METHODS[-1]}')""",
        more={"ps": _PER_SEED},
    ),
    "paired_deltas": sql(
        f"SELECT seed, round(d.shared - b.shared, 6) AS shared, round(d.retrieval - b.retrieval, 6) AS retrieval, round(d.generation - b.generation, 6) AS generation FROM ps d JOIN ps b USING (seed) WHERE d.method = '{vocab.METHODS[-1]}' AND b.method = {_BEST}", more={"ps": _PER_SEED}
    ),
    "cohen_kappa": sql(
        """SELECT lang, n, round(po, 6) AS agreement, round(CASE WHEN n < 2 THEN NULL WHEN labels < 2 THEN 1.0 WHEN pe >= 1 THEN NULL ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (
             SELECT lang, count(*) AS n, avg((a = b)::INT) AS po, len(list_distinct(list_concat(list(a), list(b)))) AS labels, (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b))) AS pe FROM raters GROUP BY GROUPING SETS ((lang), ()))""",
        "raters",
    ),
    "annotation_score": sql(
        f"""SELECT lang, count(*) FILTER (t = '') AS pending, count(*) FILTER (t <> '' AND tl IS NULL) AS invalid, count(*) FILTER (tl IS NOT NULL) AS n, round(avg((t = p)::INT) FILTER (tl IS NOT NULL), 6) AS type_accuracy, round(avg((tl = pl)::INT) FILTER (tl IS NOT NULL), 6) AS layer_accuracy
            FROM (SELECT *, {_LAYER('t')} AS tl, {_LAYER('p')} AS pl FROM (SELECT lang, ({_TYPES})[doc_id % 9 + 1] AS t, ({_TYPES})[(doc_id + a * 5 + b) % 6 + 1] AS p FROM raters)) GROUP BY GROUPING SETS ((lang), ())""",
        "raters",
    ),
    "stratified_sample": "SELECT lang, doc_id, pick FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || doc_id)) AS pick FROM documents) WHERE pick <= 5",
    "failure_rollup": sql(
        """SELECT rag, dataset, convs, coalesce(failed, 0) AS failed, coalesce(grounding, 0) AS grounding, coalesce(retrieval, 0) AS retrieval, coalesce(knowledge_boundary, 0) AS knowledge_boundary, coalesce(generation_layer, 0) AS generation_layer
           FROM (SELECT rag, dataset, count(DISTINCT conversation_id) AS convs FROM log GROUP BY ALL) LEFT JOIN (
             SELECT rag, dataset, count(*) AS failed, count(*) FILTER (failure_type = 'grounding') AS grounding, count(*) FILTER (failure_type = 'retrieval') AS retrieval, count(*) FILTER (failure_type = 'knowledge_boundary') AS knowledge_boundary, count(*) FILTER (layer = 'generation') AS generation_layer FROM c GROUP BY ALL) USING (rag, dataset)""",
        "log", more={"c": _CLS},
    ),
}
