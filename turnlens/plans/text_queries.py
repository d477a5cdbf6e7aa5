"""Queries over texts: search, grading, guards and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.functions import guards, match, slots, vocab
from turnlens.functions import text as t
from turnlens.lineage import kept
from turnlens.operators import retrieval as r
from turnlens.plans import views as v
from turnlens.plans.oracle import share, slug, sql, tokens

_lst = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
_any = lambda col, ps: "(" + " OR ".join(f"contains(lower({col}), '{p.replace(chr(39), chr(39) * 2)}')" for p in ps) + ")"


def _bench_top(spark: SparkSession, sf: str, k: int = 5, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The seeds, and the k best chunks of each with their texts."""
    chunks, bench = v.chunks(spark, sf), v.bench(spark, sf)
    asked = bench.select("item_id", F.explode(t.token_set(F.col("question"))).alias("token"))
    hits = r.unit_topk(asked, r.texts(chunks), r.weights(chunks) if weights is None else weights, k)
    return bench, kept(r.with_texts(hits, chunks))  # k rows a seed, read by several branches


def lexical_rag_profile(spark: SparkSession, sf: str) -> DataFrame:
    """How often lexical retrieve-then-answer fails: outcomes by whether the gold was in the context."""
    bench, top = _bench_top(spark, sf)
    answers = r.extractive(bench, top)
    contexts = top.groupBy("item_id").agg(F.collect_list("text").alias("ctx"))
    graded = bench.join(answers, "item_id").join(contexts, "item_id", "left").select(
        match.grade(F.col("gold"), F.col("answer"), F.lit(False)).alias("outcome"), match.gold_in_context(F.col("gold"), F.col("ctx")).alias("gold_in_context")
    )
    return graded.groupBy("outcome", "gold_in_context").agg(F.count(F.lit(1)).alias("n"))


_GOLD_IN = f"""SELECT b.item_id, coalesce(bool_or({share(tokens('b.gold'), tokens('t.text'))} >= 0.5), false) AS gic FROM bench b LEFT JOIN top5 t USING (item_id) GROUP BY ALL"""
_GRADE = (
    "CASE WHEN trim({a}) = '' THEN 'abstained' WHEN " + _any("{a}", vocab.GRADER_ABSTENTIONS) + " THEN 'abstained' WHEN {u} THEN 'hallucinated' "
    "WHEN contains(lower({a}), substring(lower({g}), 1, 30)) OR contains(lower({g}), substring(lower({a}), 1, 30)) THEN 'correct' ELSE 'wrong' END"
)
_CORRECT = (
    "CASE WHEN trim(lower({g})) = '' OR {a} = '' THEN false ELSE contains(lower({a}), substring(trim(lower({g})), 1, 30)) OR contains(trim(lower({g})), substring(lower({a}), 1, 30)) OR "
    + share(tokens("{g}"), tokens("{a}")) + " >= 0.6 END"
)


def token_idf(spark: SparkSession, sf: str) -> DataFrame:
    chunks = v.chunks(spark, sf)
    return r.idf(v.postings(chunks), chunks).select("token", "df", F.round("idf", 6).alias("idf"))


def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bench_top(spark, sf)[1].select("item_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


def extractive_answer(spark: SparkSession, sf: str) -> DataFrame:
    bench, top = _bench_top(spark, sf)
    return r.extractive(bench, top)


def distinct_n(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct n-grams over all n-grams of user messages, for n = 1 and 2, by role."""
    grams = v.msgs(spark, sf).select("role", t.space_tokens(F.col("text")).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.slice("w", i, 2)))).otherwise(F.array())
    each = grams.select("role", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.col("w").alias("g")), F.struct(F.lit(2).alias("n"), pairs.alias("g")))).alias("x")).select("role", "x.n", F.explode("x.g").alias("gram"))
    counted = each.groupBy("role", "n", "gram").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("role", "n").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("total")).select("role", F.col("n").cast("long").alias("n"), "n_distinct", "total", F.round(F.col("n_distinct") / F.col("total"), 6).alias("distinct_n"))


def jaccard_repeat(spark: SparkSession, sf: str) -> DataFrame:
    """For each answer the largest token overlap with an earlier answer of its conversation, and whether it repeats one."""
    w = Window.partitionBy("conv_id").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, -1)
    turns = v.qa_turns(spark, sf).select("conv_id", "turn_id", "gold", F.collect_list("gold").over(w).alias("before"))
    best = F.coalesce(F.array_max(F.transform("before", lambda p: t.jaccard(t.token_set(F.col("gold")), t.token_set(p)))), F.lit(0.0))
    return turns.select("conv_id", "turn_id", F.round(best, 6).alias("best"), guards.repeats(F.col("gold"), F.col("before")).alias("repeat"))


def guard_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Guards on each turn, and the first that fails."""
    turns = v.qa_turns(spark, sf)
    q, g = F.col("question"), F.col("gold")
    flags = turns.select(
        "conv_id", "turn_id", guards.latex_label(q).alias("latex"), guards.citation_only(g).alias("citation_only"), guards.restates(q, g).alias("restates"), guards.has_pronoun(q).alias("pronoun")
    )
    return flags.withColumn("first_failed", F.when(F.col("latex"), "latex").when(F.col("citation_only"), "citation_only").when(F.col("restates"), "restates").otherwise("ok"))


_MEANINGFUL = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: x NOT IN ({stop}) AND length(x) > 2)"


def slot_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of a question held against the sentences of the answer (plain and structured slots)."""
    turns = v.qa_turns(spark, sf)
    w = F.filter(F.split("question", r"[ \t\n\f\r]+"), lambda x: x != "")
    made = turns.select("conv_id", "turn_id", "gold", F.array(F.concat_ws(" ", F.slice(w, 1, 3)), F.concat(F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.lit(" :: "), F.concat_ws(" ", F.slice(w, 2, 2)))).alias("slots"))
    flags = made.select("conv_id", "turn_id", F.transform("slots", lambda s: slots.covered(s, F.col("gold"))).alias("ok"))
    n = F.size(F.filter("ok", lambda x: x))
    return flags.select("conv_id", "turn_id", n.cast("long").alias("n_covered"), F.when(n == F.size("ok"), "grounding").otherwise("response_coverage").alias("rule_label"), F.round(n / F.size("ok"), 6).alias("coverage"))


def gold_in_context(spark: SparkSession, sf: str) -> DataFrame:
    bench, top = _bench_top(spark, sf)
    ctx = top.groupBy("item_id").agg(F.collect_list("text").alias("ctx"))
    return bench.join(ctx, "item_id", "left").select("item_id", match.gold_in_context(F.col("gold"), F.col("ctx")).alias("gold_in_context"))


def retrieval_check(spark: SparkSession, sf: str) -> DataFrame:
    """present, absent, or null where there is nothing to check: gold or else evidence in the context."""
    bench, top = _bench_top(spark, sf)
    ctx = top.groupBy("item_id").agg(F.collect_list("text").alias("ctx"))
    rows = bench.join(ctx, "item_id", "left").withColumn("evidence", F.col("text"))
    one, two = slots.present(F.col("gold"), F.col("ctx")), slots.present(F.col("evidence"), F.col("ctx"))
    both = F.when(one, F.lit(True)).otherwise(two)  # a check that fails or is void leaves it to the other
    return rows.select("item_id", F.when(both, "present").when(~both, "absent").alias("retrieval"))


def contains_answer(spark: SparkSession, sf: str) -> DataFrame:
    bench, top = _bench_top(spark, sf)
    return top.join(bench.select("item_id", "gold"), "item_id").select("item_id", F.col("rank").cast("long").alias("rank"), match.contains_answer(F.col("text"), F.col("gold")).alias("has_answer"))


def abstention_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.msgs(spark, sf).filter("role = 'assistant'")
    made = F.when(F.col("turn") % 5 == 0, F.concat(F.col("text"), F.lit(" This is not stated."))).when(F.col("turn") % 7 == 0, F.lit("I don't know.")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", t.contains_any(made, vocab.GRADER_ABSTENTIONS).alias("grader"), t.contains_any(made, vocab.STUDY_ABSTENTIONS).alias("study"))


_ABST = "CASE WHEN turn % 5 = 0 THEN text || ' This is not stated.' WHEN turn % 7 = 0 THEN 'I don''t know.' ELSE text END"


def lexical_correct(spark: SparkSession, sf: str) -> DataFrame:
    bench, top = _bench_top(spark, sf)
    rows = bench.join(r.extractive(bench, top), "item_id")
    return rows.select("item_id", match.lexical_correct(F.col("gold"), F.col("answer")).alias("study_correct"), match.grade(F.col("gold"), F.col("answer"), F.lit(False)).alias("outcome"))


def failure_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Failed turns of the log, classified by rule, with the layer of the type."""
    failed = v.log(spark, sf).filter(F.col("outcome").isin("wrong", "hallucinated"))
    kind = F.when(F.col("outcome") == "hallucinated", "grounding").when(F.col("query_type") == "Unanswerable", "knowledge_boundary").otherwise("retrieval")
    layers = spark.createDataFrame(list(vocab.FAILURE_LAYERS.items()), "failure_type string, layer string")
    return failed.select("conversation_id", "turn_id", "outcome", kind.alias("failure_type"), F.lit("uncertain").alias("cause")).join(F.broadcast(layers), "failure_type")


_CLASSIFIED = """SELECT conversation_id, turn_id, outcome, rag, dataset, query_type, 'uncertain' AS cause, CASE WHEN outcome = 'hallucinated' THEN 'grounding' WHEN query_type = 'Unanswerable' THEN 'knowledge_boundary' ELSE 'retrieval' END AS failure_type
    FROM log WHERE outcome IN ('wrong', 'hallucinated')"""
_LAYERS = "(VALUES " + ", ".join(f"('{k}', '{x}')" for k, x in vocab.FAILURE_LAYERS.items()) + ") l(failure_type, layer)"


def domain_routing(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit("mt-"), F.element_at(F.array(*(F.lit(x) for x in ("ClapNQ", "govt", "fiqa", "ibmcloud", "cloud", "other"))), (F.col("conv_id") % 6 + 1).cast("int")), F.lit("-elser"))
    out = F.lit("unknown")
    for key, name in reversed(vocab.DOMAINS):
        out = F.when(F.lower(made).contains(key), name).otherwise(out)
    return v.msgs(spark, sf).select("conv_id").distinct().select("conv_id", out.alias("domain"))


def evidence_resplit(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence blobs re-split at sentence ends before a capital, the first five pieces above 25 characters."""
    marked = F.regexp_replace("text", r"([.!?])[ \t\n\f\r]+([A-Z$])", "$1␞$2")
    pieces = F.slice(F.filter(F.transform(F.split(marked, "␞"), lambda x: F.trim(x)), lambda x: F.length(x) > 25), 1, 5)
    return v.table(spark, sf, "benchmark").select("item_id", F.posexplode(pieces).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


def context_render(spark: SparkSession, sf: str) -> DataFrame:
    """The numbered context block of each seed, cut to 2400 characters."""
    _, top = _bench_top(spark, sf)
    docs = top.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("docs"))
    block = F.array_join(F.transform("docs", lambda d: F.concat(F.lit("["), d["rank"].cast("string"), F.lit("] "), F.substring(d["text"], 1, 500))), "\n\n")
    return docs.select("item_id", F.substring(block, 1, 2400).alias("block"))


def slugify(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.kg_nodes(spark, sf)
    return rows.select("entity", "type", t.slug(F.concat(F.lit(" ("), F.col("entity"), F.lit(") é!"))).alias("slug"), t.slug(F.regexp_replace("entity", "[A-Za-z0-9]", "-")).alias("blank"))


QUERIES = {f.__name__: f for f in (
    lexical_rag_profile, token_idf, lexical_topk, extractive_answer, distinct_n, jaccard_repeat, guard_flags, slot_attribution, gold_in_context, retrieval_check,
    contains_answer, abstention_flags, lexical_correct, failure_classify, domain_routing, evidence_resplit, context_render, slugify,
)}

_STOP = lambda c, n: f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')), lambda x: x NOT IN ({_lst(vocab.STOP_WORDS)}) AND length(x) > {n})"
_SENTS = f"list_transform(list_filter(regexp_split_to_array(gold, '[.!?\\n;]+'), lambda s: trim(s) <> ''), lambda s: {_STOP('s', 0)})"

SQL = {
    "lexical_rag_profile": sql(
        f"SELECT outcome, gic AS gold_in_context, count(*) AS n FROM (SELECT item_id, {_GRADE.format(a='answer', g='gold', u='false')} AS outcome FROM answers) JOIN g USING (item_id) GROUP BY ALL", "answers", more={"g": _GOLD_IN}
    ),
    "token_idf": sql("SELECT token, df, round(idf, 6) AS idf FROM idf", "idf"),
    "lexical_topk": sql("SELECT item_id, rank, chunk_id, score FROM top5", "top5"),
    "extractive_answer": sql("SELECT item_id, answer FROM answers", "answers"),
    "distinct_n": """WITH w AS (SELECT role, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM conversations),
        g AS (SELECT role, 1 AS n, unnest(w) AS gram FROM w UNION ALL SELECT role, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)
        SELECT role, n, count(DISTINCT gram) AS n_distinct, count(*) AS total, round(count(DISTINCT gram) / count(*), 6) AS distinct_n FROM g GROUP BY role, n""",
    "jaccard_repeat": sql(
        f"""SELECT conv_id, turn_id, round(coalesce(max(j), 0), 6) AS best, coalesce(bool_or(pt <> 0 AND gt <> 0 AND (g = p OR contains(p, g) OR j >= 0.8)), false) AS repeat FROM (
              SELECT a.conv_id, a.turn_id, lower(trim(a.gold)) AS g, lower(trim(b.gold)) AS p, len({tokens('a.gold')}) AS gt, len({tokens('b.gold')}) AS pt,
                CASE WHEN len({tokens('a.gold')}) = 0 OR len({tokens('b.gold')}) = 0 THEN 0.0 ELSE len(list_intersect({tokens('a.gold')}, {tokens('b.gold')})) / len(list_distinct(list_concat({tokens('a.gold')}, {tokens('b.gold')}))) END AS j
              FROM qa_turns a LEFT JOIN qa_turns b ON a.conv_id = b.conv_id AND b.turn_id < a.turn_id) GROUP BY conv_id, turn_id""",
        "qa_turns",
    ),
    "guard_flags": sql(
        f"""SELECT *, CASE WHEN latex THEN 'latex' WHEN citation_only THEN 'citation_only' WHEN restates THEN 'restates' ELSE 'ok' END AS first_failed FROM (
              SELECT conv_id, turn_id, regexp_matches(question, '(?i)\\b(?:TABREF|SECREF|FIGREF|BIBREF|EQREF)[0-9]*\\b') AS latex,
                regexp_matches(gold, '\\[\\s*[0-9]+\\s*\\]') AND len(list_distinct({_MEANINGFUL.format(c="regexp_replace(gold, '\\[\\s*[0-9]+\\s*\\]', '', 'g')", stop=_lst(vocab.GRAMMAR_WORDS))})) < 3 AS citation_only,
                len(ga) >= 5 AND len(list_filter(list_distinct(ga), lambda x: NOT list_contains(qa, x) AND NOT regexp_full_match(x, '[0-9]+'))) < 2 AS restates,
                regexp_matches(lower(question), '(^|[^a-z0-9_])({"|".join(vocab.PRONOUNS)})([^a-z0-9_]|$)') AS pronoun
              FROM (SELECT *, {_MEANINGFUL.format(c='gold', stop=_lst(vocab.COMMON_WORDS))} AS ga, {_MEANINGFUL.format(c='question', stop=_lst(vocab.COMMON_WORDS))} AS qa FROM qa_turns))""",
        "qa_turns",
    ),
    "slot_attribution": sql(
        f"""SELECT conv_id, turn_id, (p::INT + s::INT)::BIGINT AS n_covered, CASE WHEN p AND s THEN 'grounding' ELSE 'response_coverage' END AS rule_label, round((p::INT + s::INT) / 2, 6) AS coverage FROM (
              SELECT conv_id, turn_id, len(pt) > 0 AND len(list_filter(ss, lambda x: len(list_intersect(pt, x)) / len(pt) >= 0.6)) > 0 AS p,
                len(et) > 0 AND len(list_filter(ss, lambda x: len(list_intersect(et, x)) = len(et) AND (len(dt) = 0 OR len(list_intersect(dt, x)) / len(dt) >= 0.5))) > 0 AS s
              FROM (SELECT conv_id, turn_id, {_SENTS} AS ss, {_STOP("array_to_string(w[1:3], ' ')", 0)} AS pt, {_STOP("coalesce(w[1], '')", 0)} AS et, {_STOP("array_to_string(w[2:3], ' ')", 0)} AS dt
                    FROM (SELECT *, list_filter(regexp_split_to_array(question, '[ \\t\\n\\f\\r]+'), lambda x: x <> '') AS w FROM qa_turns)))""",
        "qa_turns",
    ),
    "gold_in_context": sql("SELECT item_id, gic AS gold_in_context FROM g", "top5", "bench", more={"g": _GOLD_IN}),
    "retrieval_check": sql(
        f"""SELECT item_id, CASE WHEN coalesce(one, false) OR coalesce(two, false) THEN 'present' WHEN two IS NOT NULL THEN 'absent' END AS retrieval FROM (
              SELECT item_id, CASE WHEN len(g) > 0 THEN bool_or(len(list_intersect(g, c)) / len(g) >= 0.5) END AS one, CASE WHEN len(e) > 0 THEN bool_or(len(list_intersect(e, c)) / len(e) >= 0.5) END AS two
              FROM (SELECT b.item_id, {_STOP('b.gold', 1)} AS g, {_STOP('b.text', 1)} AS e, {_STOP('t.text', 1)} AS c FROM bench b LEFT JOIN top5 t USING (item_id)) GROUP BY item_id, g, e)""",
        "bench", "top5",
    ),
    "contains_answer": sql(
        f"SELECT item_id, rank, CASE WHEN trim(gold) = '' THEN false ELSE contains(lower(t.text), trim(lower(gold))) OR {share(tokens('gold'), tokens('t.text'))} >= 0.6 END AS has_answer FROM top5 t JOIN bench USING (item_id)", "top5", "bench"
    ),
    "abstention_flags": f"SELECT conv_id, turn, {_any('x', vocab.GRADER_ABSTENTIONS)} AS grader, {_any('x', vocab.STUDY_ABSTENTIONS)} AS study FROM (SELECT *, {_ABST} AS x FROM conversations WHERE role = 'assistant')",
    "lexical_correct": sql(f"SELECT item_id, {_CORRECT.format(g='gold', a='answer')} AS study_correct, {_GRADE.format(a='answer', g='gold', u='false')} AS outcome FROM answers", "answers"),
    "failure_classify": sql(f"SELECT conversation_id, turn_id, outcome, failure_type, cause, layer FROM ({_CLASSIFIED}) JOIN {_LAYERS} USING (failure_type)", "log"),
    "domain_routing": """SELECT conv_id, CASE WHEN contains(d, 'clapnq') THEN 'clapnq' WHEN contains(d, 'govt') THEN 'govt' WHEN contains(d, 'fiqa') THEN 'fiqa' WHEN contains(d, 'ibmcloud') OR contains(d, 'cloud') THEN 'cloud' ELSE 'unknown' END AS domain
        FROM (SELECT DISTINCT conv_id, lower('mt-' || (['ClapNQ', 'govt', 'fiqa', 'ibmcloud', 'cloud', 'other'])[conv_id % 6 + 1] || '-elser') AS d FROM conversations)""",
    "evidence_resplit": """SELECT item_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS piece FROM (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\f\\r]+([A-Z$])', '\\1␞\\2', 'g'), '␞'), lambda x: trim(x)), lambda x: length(x) > 25)[1:5] AS ps FROM benchmark)""",
    "context_render": sql("SELECT item_id, substring(string_agg('[' || rank || '] ' || substring(text, 1, 500), E'\\n\\n' ORDER BY rank), 1, 2400) AS block FROM top5 GROUP BY item_id", "top5"),
    "slugify": sql(f"SELECT entity, type, {slug(chr(39) + ' (' + chr(39) + ' || entity || ' + chr(39) + ') é!' + chr(39))} AS slug, {slug('regexp_replace(entity, ' + chr(39) + '[A-Za-z0-9]' + chr(39) + ', ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS blank FROM kg_nodes", "kg_nodes"),
}
