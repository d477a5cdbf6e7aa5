"""Control of conversations, and the injected-failure study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.functions import match, vocab
from turnlens.lineage import kept
from turnlens.operators import control, graph, loop, study, systems
from turnlens.plans import retrieval_queries as rq
from turnlens.plans import text_queries as tq
from turnlens.plans import views as v
from turnlens.plans.oracle import share, sql, tokens

FORCED = ("Multi-Hop", "Follow-Up", "Comparative", "Clarification")
_METHODS, _RAGS, _DATA = ("proposed", "xie_subq", "single", "mtrag"), ("vector", "graph", "raptor", "hippo", "selfrag"), ("qasper", "multihoprag", "official")


def method_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of every method, system and corpus but the infeasible: graph indexes over the official corpus, human replay elsewhere."""
    dim = lambda name, values: spark.createDataFrame([(x,) for x in values], f"{name} string")
    runs = dim("method", _METHODS).crossJoin(dim("rag", _RAGS)).crossJoin(dim("dataset", _DATA))  # three short lists
    return runs.filter(~((F.col("dataset") == "official") & F.col("rag").isin("graph", "raptor", "hippo")) & ((F.col("method") == "mtrag") == (F.col("dataset") == "official")))


def query_templates(spark: SparkSession, sf: str) -> DataFrame:
    """An offline question of each turn's type about the first entities of its answer."""
    kinds = F.array(*(F.lit(t) for t, *_ in vocab.QUERY_TYPES))
    e = graph.entities(F.col("gold"))
    rows = v.qa_turns(spark, sf).select("conv_id", "turn_id", F.element_at(kinds, (F.col("turn_id") % 8 + 1).cast("int")).alias("query_type"), F.get(e, F.lit(0)).alias("e0"), F.get(e, F.lit(1)).alias("e1"))
    spec = spark.createDataFrame(vocab.QUERY_TYPES, "query_type string, capability string, expected_failure string, difficulty long")
    return rows.join(F.broadcast(spec), "query_type").select("conv_id", "turn_id", "query_type", control.template(F.col("query_type"), F.col("e0"), F.col("e1")).alias("question"), "expected_failure", "difficulty")


def reroute(spark: SparkSession, sf: str) -> DataFrame:
    """Comparative turns become Multi-Hop where the conversation's customer has no comparable neighbour."""
    peers = v.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("peers"))
    rows = v.log(spark, sf).select("conversation_id", "turn_id", "query_type", (F.col("conversation_id") % 40).alias("nk"))
    return rows.join(peers, F.col("nk") == F.col("c_nationkey"), "left").select("conversation_id", "turn_id", F.when((F.col("query_type") == "Comparative") & F.col("peers").isNull(), "Multi-Hop").otherwise(F.col("query_type")).alias("query_type"))


def controller_fold(spark: SparkSession, sf: str) -> DataFrame:
    return control.fold(v.log(spark, sf))


def forced_types(spark: SparkSession, sf: str) -> DataFrame:
    return v.log(spark, sf).select("conversation_id", "turn_id", control.forced(F.col("turn_id"), FORCED).alias("next_type"))


def single_turn(spark: SparkSession, sf: str) -> DataFrame:
    return v.log(spark, sf).filter("turn_id = 0").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def ablation_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Failure rates of the controller's arm and the random one, and their difference."""
    bad = F.col("outcome").isin("wrong", "hallucinated").cast("double")
    arm = lambda k: F.avg(F.when(F.col("conversation_id") % 2 == k, bad))
    return v.log(spark, sf).groupBy("dataset").agg(F.round(arm(0), 6).alias("controller"), F.round(arm(1), 6).alias("random"), F.round(arm(0) - arm(1), 6).alias("delta"))


def counterfactual_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of turns answered with their history against those of the bare question.

    The two searches share the weights; a turn without history asks the same in both, so it is searched once.
    """
    chunks = v.chunks(spark, sf)
    asked, weights = kept(rq.history_queries(spark, sf)), tq.r.weights(chunks)
    bare = asked.filter("query <> trim(coalesce(question, ''))").withColumn("query", F.col("question"))
    real, cf = (rq._answered(q, rq._found(q, chunks, 5, weights)) for q in (asked, bare))
    both = real.select("qid", "outcome").join(cf.select("qid", F.col("outcome").alias("cf_outcome")), "qid", "left")
    return both.groupBy("outcome", F.coalesce("cf_outcome", "outcome").alias("cf_outcome")).agg(F.count(F.lit(1)).alias("n"))


def _seeds(spark: SparkSession, sf: str, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Seeds (item_id, question, answer, passage) and their contexts (item_id, pos, text): the passage, then what search finds."""
    bench, top = tq._bench_top(spark, sf, weights=weights)
    seeds = bench.select("item_id", "question", F.col("gold").alias("answer"), F.col("text").alias("passage"))
    own = seeds.select("item_id", F.lit(0).alias("pos"), F.col("passage").alias("text"))
    return seeds, own.unionByName(top.select("item_id", F.col("rank").alias("pos"), "text"))


def distractors(spark: SparkSession, sf: str) -> DataFrame:
    return study.distractors(_seeds(spark, sf)[1]).select("item_id", F.col("d").cast("long").alias("d"), F.md5("text").alias("text_md5"))


def near_miss(spark: SparkSession, sf: str) -> DataFrame:
    return study.near_misses(*_seeds(spark, sf)).select("item_id", F.col("d").cast("long").alias("d"), F.md5("text").alias("text_md5"))


def _cases(spark: SparkSession, sf: str, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cases with the system's answer and whether the failure fired, and their contexts; kept, as the probes ask again."""
    seeds, own = _seeds(spark, sf, weights)
    cases, ctx = study.inject(seeds, kept(own))
    ctx = kept(ctx)
    got = study.answered(cases, ctx, F.col("question"), "answer")
    shown = ctx.groupBy("case_id").agg(F.collect_list("text").alias("ctx"))
    fired = got.join(shown, "case_id").withColumn("fired", match.did_fail(F.col("gold"), F.col("answer"), F.col("unanswerable"))).withColumn("present", match.gold_in_context(F.col("passage"), F.col("ctx")))
    return kept(fired), ctx


def inject_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf)[0].select("case_id", "truth", "fired", "present", F.md5("answer").alias("answer_md5"))


def attrib_single(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cases(spark, sf)[0].filter("fired").withColumn("pred", study.base(F.lit(False), F.col("present")))
    return rows.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def _recovered(spark: SparkSession, sf: str, fired: DataFrame, weights: DataFrame) -> DataFrame:
    """(case_id, core, follow_up): whether a fresh search for a sub-question of either kind recovers the answer."""
    chunks = v.chunks(spark, sf)
    subs = kept(study.sub_questions(fired).withColumn("sid", F.concat_ws("#", "case_id", "i")))
    found = tq.r.unit_topk(subs.select("sid", F.explode(tq.t.token_set(F.col("question"))).alias("token")), tq.r.texts(chunks), weights, 5, query="sid")
    again = subs.join(tq.r.extractive(subs, kept(tq.r.with_texts(found, chunks)), "sid"), "sid").join(fired.select("case_id", "gold"), "case_id")
    right = match.lexical_correct(F.col("gold"), F.col("answer"))
    by = again.groupBy("case_id").agg(*(F.coalesce(F.bool_or(right & (F.col("kind") == k)), F.lit(False)).alias(n) for k, n in (("core", "core"), ("follow-up", "follow_up"))))
    return fired.select("case_id").join(by, "case_id", "left").select("case_id", F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("follow_up", F.lit(False)).alias("follow_up"))


def attrib_static(spark: SparkSession, sf: str) -> DataFrame:
    """Attribution by whether a fresh search for core sub-questions recovers the answer."""
    weights = tq.r.weights(v.chunks(spark, sf))
    fired = _cases(spark, sf, weights)[0].filter("fired")
    rows = fired.join(_recovered(spark, sf, fired, weights), "case_id")
    return rows.groupBy("truth", study.base(F.col("core"), F.col("present")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def attrib_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    rows, ctx = _cases(spark, sf)
    return study.dynamic(rows.filter("fired"), ctx).groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def study_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The four predictors over the same fired cases: by method and truth, cases and how many are told right."""
    weights = tq.r.weights(v.chunks(spark, sf))
    rows, ctx = _cases(spark, sf, weights)
    fired = rows.filter("fired")
    probed = study.dynamic(fired, ctx).join(_recovered(spark, sf, fired, weights), "case_id")
    preds = (study.base(F.lit(False), F.col("present")), study.base(F.col("core"), F.col("present")), study.base(F.col("follow_up"), F.col("present")), F.col("pred"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), p.alias("pred")) for m, p in zip(vocab.METHODS, preds, strict=True))))
    return probed.select("truth", each.alias("m")).groupBy("m.method", "truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m.pred") == F.col("truth")).alias("n_right"))


def adaptive_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Three adaptive turns from every seed; answers depend on one another, so there is no SQL."""
    seeds = v.bench(spark, sf).select(F.col("item_id").alias("qid"), "question", "gold", F.col("text").alias("passage"))
    rows = loop.run(seeds, v.chunks(spark, sf), 3)
    return rows.select("qid", "turn_id", "query_type", "outcome", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


QUERIES = {f.__name__: f for f in (
    adaptive_loop, method_matrix, query_templates, reroute, controller_fold, forced_types, single_turn, ablation_delta, counterfactual_probe, distractors, near_miss, inject_cases, attrib_single, attrib_static, attrib_dynamic, study_scores,
)}

_vals = lambda n, xs: f"(VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in xs)}) {n}_t({n})"
_KINDS = "[" + ", ".join(f"'{t}'" for t, *_ in vocab.QUERY_TYPES) + "]"
_PH = """list_filter(list_transform(regexp_extract_all(regexp_replace(gold, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g'), '(?:^|[^\\p{L}\\p{N}_])([A-Z][a-zA-Z0-9]+(?:\\s+(?:of|the|de|van|von)?\\s*[A-Z][a-zA-Z0-9]+)*)(?:[^\\p{L}\\p{N}_]|$)', 1), lambda p: replace(p, '  ', ' ')),
    lambda p: string_split(p, ' ')[1] NOT IN (""" + ", ".join(f"'{w}'" for w in vocab.STOP_CAPITALS) + ") AND length(p) >= 3)"
_NEXT = """CASE WHEN f1 = 'Follow-Up' AND last IN ('Comparative', 'Multi-Hop', 'Ambiguous Reference', 'Clarification') THEN CASE WHEN last = 'Clarification' THEN 'Comparative' ELSE 'Clarification' END ELSE f1 END"""
_FIRST = """CASE WHEN l.outcome = 'wrong' THEN 'Correction' WHEN l.outcome = 'hallucinated' THEN 'Unanswerable' WHEN l.outcome = 'abstained' THEN CASE WHEN l.turn_id % 2 = 0 THEN 'Clarification' ELSE 'Follow-Up' END
    WHEN (f.n + 1) % 4 = 0 THEN 'Topic Shift' ELSE (['Multi-Hop', 'Comparative', 'Ambiguous Reference'])[(f.n + 1) % 3 + 1] END"""
_CORR = tq._CORRECT
_SEEDS = {
    "seeds": "SELECT item_id, question, gold AS answer, text AS passage FROM bench",
    "ctxs": "SELECT item_id, 0 AS pos, passage AS text FROM seeds UNION ALL SELECT item_id, rank, text FROM top5",
    "dis": "SELECT item_id, d, text FROM (SELECT s.item_id, c.text, row_number() OVER (PARTITION BY s.item_id ORDER BY c.item_id, c.pos) AS d FROM seeds s JOIN ctxs c ON c.item_id <> s.item_id) WHERE d <= 5",
    "near": f"""SELECT item_id, d, text FROM (SELECT item_id, text, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS d FROM ctxs JOIN seeds USING (item_id) WHERE pos > 0 AND NOT (trim(answer) <> '' AND (contains(lower(text), trim(lower(answer))) OR {share(tokens('answer'), tokens('text'))} >= 0.6))) WHERE d <= 3""",
}
def _grounded(questions: str, contexts: str) -> str:
    """(case_id, grounded) as :func:`study.grounding` has it."""
    return f"""SELECT q.case_id, coalesce(g, 0.0) AS grounded FROM {questions} q LEFT JOIN (
        SELECT case_id, max(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, {tokens('sent')})) / len(q) END) AS g FROM (
          SELECT case_id, {tokens('question')} AS q, unnest(string_split(regexp_replace(x.text, '([.!?])[ \\t\\n\\f\\r]+', '\\1␞', 'g'), '␞')) AS sent FROM {contexts} x JOIN {questions} USING (case_id)) GROUP BY case_id) b ON b.case_id = q.case_id"""


_CASES = {
    **_SEEDS,
    "gen": "SELECT format('gen-{:03d}', item_id) AS case_id, question || '" + vocab.ABSENT_DETAIL + "' AS question FROM seeds",
    "gen_x": "SELECT format('gen-{:03d}', item_id) AS case_id, 1 AS rank, passage AS text FROM seeds UNION ALL SELECT format('gen-{:03d}', item_id), d + 1, text FROM dis WHERE d <= 2",
    "gen_g": _grounded("gen", "gen_x"),
    "cs": """SELECT format('ret-{:03d}', item_id) AS case_id, 'Retrieval' AS truth, question, '' AS antecedent, '' AS referent, answer AS gold, passage, false AS unanswerable FROM seeds
        UNION ALL SELECT format('con-{:03d}', item_id), 'Conversation', '""" + vocab.PRONOUN_QUESTION + """', 'What is ' || answer || ' most associated with there?', trim(answer), answer, passage, false FROM seeds
        UNION ALL SELECT case_id, 'Generation', question, '', '', 'I don''t know.', '', true FROM gen JOIN gen_g USING (case_id) WHERE grounded < 0.5""",
    "cx": """SELECT case_id, rank, text FROM gen_x JOIN gen_g USING (case_id) WHERE grounded < 0.5 UNION ALL SELECT format('ret-{:03d}', item_id) AS case_id, d AS rank, text FROM near UNION ALL SELECT format('ret-{:03d}', item_id), d, text FROM dis WHERE d <= 3 AND item_id NOT IN (SELECT item_id FROM near)
        UNION ALL SELECT format('con-{:03d}', item_id), 1, passage FROM seeds UNION ALL SELECT format('con-{:03d}', item_id), 2, text FROM dis WHERE d = 1""",
    **rq._extract("an", "cs", "cx", "case_id"),
    "ca": f"""SELECT cs.*, an.answer, CASE WHEN unanswerable THEN NOT {tq._any('answer', vocab.STUDY_ABSTENTIONS)} ELSE NOT {_CORR.format(g='gold', a='answer')} END AS fired, coalesce((SELECT bool_or({share(tokens('cs.passage'), tokens('cx.text'))} >= 0.5) FROM cx WHERE cx.case_id = cs.case_id), false) AS present FROM cs JOIN an USING (case_id)""",
    "fired": "SELECT * EXCLUDE (answer) FROM ca WHERE fired",
}
_STATIC = {
    "sub": r"""SELECT case_id, case_id || '#' || i AS sid, i, CASE WHEN i = 0 THEN 'core' ELSE 'follow-up' END AS kind, question FROM (SELECT case_id, unnest(ps) AS question, generate_subscripts(ps, 1) - 1 AS i FROM (
        SELECT case_id, list_filter(list_transform(string_split(regexp_replace(question, '([.!?])[ \t\n\f\r]+', '\1␞', 'g'), '␞'), lambda s: trim(s)), lambda s: s <> '')[1:6] AS ps FROM fired))""",
    **rq._search("fs", "sub", "question", "sid", "chunks", 5),
    **rq._extract("ag", "sub", "fs", "sid"),
    "rec": f"""SELECT f.case_id, coalesce(bool_or(kind = 'core' AND ok), false) AS core, coalesce(bool_or(kind = 'follow-up' AND ok), false) AS follow_up FROM fired f LEFT JOIN (
        SELECT sub.case_id, kind, {_CORR.format(g='gold', a='answer')} AS ok FROM sub JOIN ag USING (sid) JOIN fired g ON g.case_id = sub.case_id) s ON s.case_id = f.case_id GROUP BY f.case_id""",
}
_PROBE = "'In the question \"' || question || '\", what specific entity does the pronoun refer to? Reply with ONLY the entity name.'"
_DYNAMIC = {
    "nq": "SELECT case_id, antecedent AS question FROM fired", **rq._extract("p1", "nq", "cx", "case_id"),
    "ps": "SELECT case_id, 1 AS rank, passage AS text FROM fired WHERE passage <> ''", **rq._extract("p2", "fired", "ps", "case_id"),
    "rp": f"SELECT case_id, {_PROBE} AS question FROM fired", **rq._extract("r0", "rp", "cx", "case_id"),
    "hx": "SELECT * FROM cx UNION ALL SELECT case_id, 0, referent FROM fired WHERE referent <> ''", **rq._extract("r1", "rp", "hx", "case_id"),
    "gr": _grounded("fired", "cx"),
    "dyn": f"""SELECT case_id, truth, present, CASE WHEN antecedent <> '' AND {_CORR.format(g='gold', a='a1')} THEN 'Conversation'
            WHEN referent <> '' AND {_CORR.format(g='referent', a='r1')} AND NOT {_CORR.format(g='referent', a='r0')} THEN 'Conversation'
            WHEN passage <> '' AND {_CORR.format(g='gold', a='a2')} THEN 'Retrieval' WHEN grounded < 0.5 AND NOT {tq._any('a', vocab.STUDY_ABSTENTIONS)} THEN 'Generation' WHEN present THEN 'Generation' ELSE 'Retrieval' END AS pred
        FROM (SELECT fired.*, ca.answer AS a, p1.answer AS a1, p2.answer AS a2, r0.answer AS r0, r1.answer AS r1, grounded FROM fired JOIN ca USING (case_id) JOIN p1 USING (case_id) JOIN p2 USING (case_id) JOIN r0 USING (case_id) JOIN r1 USING (case_id) JOIN gr USING (case_id))""",
}
_BASE = "CASE WHEN {r} OR present THEN 'Generation' ELSE 'Retrieval' END"
_s = lambda body, more=None: sql(body, "bench", "top5", more={**_CASES, **(more or {})})
SQL = {
    "method_matrix": f"SELECT * FROM {_vals('method', _METHODS)}, {_vals('rag', _RAGS)}, {_vals('dataset', _DATA)} WHERE NOT (dataset = 'official' AND rag IN ('graph', 'raptor', 'hippo')) AND (method = 'mtrag') = (dataset = 'official')",
    "query_templates": sql(
        f"""SELECT conv_id, turn_id, query_type, CASE query_type WHEN 'Follow-Up' THEN 'What more can you tell me about it?' WHEN 'Clarification' THEN 'Can you explain that more simply?' WHEN 'Comparative' THEN 'How do ' || a || ' and ' || b || ' compare?'
              WHEN 'Correction' THEN 'Actually, I meant ' || b || ', not ' || a || '. What about ' || b || '?' WHEN 'Topic Shift' THEN 'Now tell me about ' || b || '.' WHEN 'Unanswerable' THEN 'What is ' || a || '''s personal TikTok username?'
              WHEN 'Multi-Hop' THEN 'Based on what we discussed, how is ' || a || ' connected to ' || b || '?' ELSE 'What else is it known for?' END AS question, expected_failure, difficulty
            FROM (SELECT conv_id, turn_id, ({_KINDS})[turn_id % 8 + 1] AS query_type, coalesce(e[1], 'the main subject') AS a, coalesce(e[2], e[1], 'the main subject') AS b FROM (
                SELECT *, list_filter(ps, lambda p, i: list_position(list_transform(ps, lambda q: lower(q)), lower(p)) = i) AS e FROM (SELECT *, {_PH} AS ps FROM qa_turns)))
            JOIN (VALUES {', '.join(f"('{t}', '{f}', {d}::BIGINT)" for t, _, f, d in vocab.QUERY_TYPES)}) q(query_type, expected_failure, difficulty) USING (query_type)""",
        "qa_turns",
    ),
    "reroute": sql("SELECT conversation_id, turn_id, CASE WHEN query_type = 'Comparative' AND conversation_id % 40 NOT IN (SELECT DISTINCT c_nationkey FROM customer) THEN 'Multi-Hop' ELSE query_type END AS query_type FROM log", "log"),
    "forced_types": sql(f"SELECT conversation_id, turn_id, ([{', '.join(f'{chr(39)}{x}{chr(39)}' for x in FORCED)}])[turn_id % {len(FORCED)} + 1] AS next_type FROM log", "log"),
    "single_turn": sql("SELECT outcome, count(*) AS n FROM log WHERE turn_id = 0 GROUP BY outcome", "log"),
    "ablation_delta": sql(
        "SELECT dataset, round(c, 6) AS controller, round(r, 6) AS random, round(c - r, 6) AS delta FROM (SELECT dataset, avg((outcome IN ('wrong', 'hallucinated'))::INT) FILTER (conversation_id % 2 = 0) AS c, avg((outcome IN ('wrong', 'hallucinated'))::INT) FILTER (conversation_id % 2 = 1) AS r FROM log GROUP BY dataset)", "log"
    ),
    "counterfactual_probe": sql(
        f"""SELECT {tq._GRADE.format(a='a1', g='gold', u='false')} AS outcome, {tq._GRADE.format(a='a2', g='gold', u='false')} AS cf_outcome, count(*) AS n FROM (SELECT qid, gold, ans.answer AS a1, an2.answer AS a2 FROM hq JOIN ans USING (qid) JOIN an2 USING (qid)) GROUP BY ALL""",
        "qa_turns", "chunks",
        more={"hq": rq._HQ, **rq._search("top", "hq", "query", "qid", "chunks", 5), **rq._extract("ans", "hq", "top", "qid"), **rq._search("tp2", "hq", "question", "qid", "chunks", 5), **rq._extract("an2", "hq", "tp2", "qid")},
    ),
    "distractors": sql("SELECT item_id, d, md5(text) AS text_md5 FROM dis", "bench", "top5", more=_SEEDS),
    "near_miss": sql("SELECT item_id, d, md5(text) AS text_md5 FROM near", "bench", "top5", more=_SEEDS),
    "inject_cases": _s("SELECT case_id, truth, fired, present, md5(answer) AS answer_md5 FROM ca"),
    "attrib_single": _s("SELECT truth, CASE WHEN present THEN 'Generation' ELSE 'Retrieval' END AS pred, count(*) AS n FROM fired GROUP BY ALL"),
    "attrib_static": _s(f"SELECT truth, {_BASE.format(r='core')} AS pred, count(*) AS n FROM fired JOIN rec USING (case_id) GROUP BY ALL", _STATIC),
    "attrib_dynamic": _s("SELECT truth, pred, count(*) AS n FROM dyn GROUP BY ALL", _DYNAMIC),
    "study_scores": _s(
        "SELECT method, truth, count(*) AS n, count(*) FILTER (pred = truth) AS n_right FROM ("
        + " UNION ALL ".join(f"SELECT '{m}' AS method, truth, {p} AS pred FROM dyn JOIN rec USING (case_id)" for m, p in zip(vocab.METHODS, (*(_BASE.format(r=r) for r in ("false", "core", "follow_up")), "pred"), strict=True))
        + ") GROUP BY ALL",
        _STATIC | _DYNAMIC,
    ),
}
_fold = f"""SELECT conversation_id, -1::BIGINT AS turn_id, 'Seed' AS last, 0::BIGINT AS n FROM (SELECT DISTINCT conversation_id FROM log)
    UNION ALL SELECT conversation_id, turn_id, {_NEXT}, n FROM (SELECT conversation_id, turn_id, last, n, CASE WHEN first = last THEN CASE WHEN last <> 'Clarification' THEN 'Clarification' ELSE 'Comparative' END ELSE first END AS f1
      FROM (SELECT l.conversation_id, l.turn_id, f.last, f.n + (l.outcome = 'correct')::INT AS n, {_FIRST.replace('(f.n + 1)', "(f.n + (l.outcome = 'correct')::INT)")} AS first FROM fold f JOIN log l ON l.conversation_id = f.conversation_id AND l.turn_id = f.turn_id + 1))"""
SQL["controller_fold"] = sql("SELECT conversation_id, turn_id, last AS next_type FROM fold WHERE turn_id >= 0", "log", more={"fold": _fold}).replace("WITH ", "WITH RECURSIVE ", 1)
