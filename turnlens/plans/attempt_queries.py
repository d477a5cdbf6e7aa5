"""Questions of every type with guards and retries, and seeds grounded before use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.functions import vocab
from turnlens.operators import attempts, graph
from turnlens.plans import control_queries as cq
from turnlens.plans import text_queries as tq
from turnlens.plans import views as v
from turnlens.plans.oracle import in_, sql, tokens


def guarded_turns(spark: SparkSession, sf: str) -> DataFrame:
    """A question of every type after each seed, tried until no guard objects: how often, why not before, and what came of it."""
    types = F.explode(F.array(*(F.lit(t[0]) for t in vocab.QUERY_TYPES)))
    seeds = v.bench(spark, sf).select(F.col("item_id").alias("qid"), graph.entities(F.col("text")).alias("entities"), F.array("question", "gold").alias("history"), F.array("gold").alias("answers"), F.array("text").alias("evidence"), types.alias("query_type"))
    rows = attempts.typed(attempts.generated(seeds).withColumn("proposed", F.lit(0)))
    return rows.select(
        F.col("qid").alias("item_id"), "asked_type", "query_type", F.col("attempts").cast("long").alias("attempts"), F.array_join("reasons", ",").alias("reasons"), "gave_up",
        F.md5("question").alias("question_md5"), F.md5("gold").alias("gold_md5"), F.col("difficulty").cast("long").alias("difficulty"),
    )


def seed_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Which attempt grounds each seed's question, by which passage, and which questions had to be replaced."""
    bench, top = tq._bench_top(spark, sf, attempts.WIDER[-1])
    seeds = bench.select(F.col("item_id").alias("qid"), "question")
    got = attempts.grounded_seeds(seeds, top.withColumnRenamed("item_id", "qid"))
    return got.select(F.col("qid").alias("item_id"), F.md5("question").alias("question_md5"), F.col("attempt").cast("long").alias("attempt"), "rewritten", "chunk_id")


QUERIES = {f.__name__: f for f in (guarded_turns, seed_grounding)}

_PH = cq._PH.replace("gold", "{c}")
_ENTITIES = "list_filter(ps, lambda p, i: list_position(list_transform(ps, lambda q: lower(q)), lower(p)) = i)"
_SENTS = "string_split(regexp_replace({}, '([.!?])[ \\t\\n\\f\\r]+', '\\1␞', 'g'), '␞')"


def _template(kind: str, a: str, b: str) -> str:
    """The question of a type about two entities, as the templates of the vocabulary have it."""
    def filled(text: str) -> str:
        parts = text.replace("'", "''").replace("{0}", f"' || coalesce({a}, 'the main subject') || '").replace("{1}", f"' || coalesce({b}, {a}, 'the main subject') || '")
        return f"'{parts}'"

    return f"CASE {kind} " + " ".join(f"WHEN '{name}' THEN {filled(text)}" for name, text in vocab.TEMPLATES.items()) + " END"


def _meaningful(c: str, stop: list[str]) -> str:
    return tq._MEANINGFUL.format(c=c, stop=", ".join(f"'{w}'" for w in stop))


_LABEL = lambda c: f"regexp_matches(coalesce({c}, ''), '(?i)\\b(?:TABREF|SECREF|FIGREF|BIBREF|EQREF)\\d*\\b')"
_LONG = lambda c: f"regexp_extract_all(lower({c}), '[a-z]{{4,}}')"
_CLARIFY = "[" + ", ".join(f"'{w}'" for w in vocab.CLARIFY_WORDS) + "]"
_OWN = f"list_filter({_LONG('question')}, lambda w: NOT list_contains({_CLARIFY}, w))"
_SAID = _LONG("(h1 || ' ' || h2)")
_STRUCTURE = f"""CASE WHEN query_type IN {in_(attempts.BY_PRONOUN)} THEN NOT regexp_matches(lower(question), '(^|[^a-z0-9_])({'|'.join(vocab.PRONOUNS)})([^a-z0-9_]|$)') OR (coalesce(trim(target), '') <> '' AND contains(lower(question), lower(trim(target))))
    WHEN query_type = 'Clarification' THEN len({_OWN}) > 0 AND len({_SAID}) > 0 AND NOT list_has_any({_OWN}, {_SAID}) ELSE false END"""
_BARE = "regexp_replace(gold, '\\[\\s*\\d+\\s*\\]', '', 'g')"
_CITES = f"(regexp_matches(gold, '\\[\\s*\\d+\\s*\\]') AND len(list_distinct({_meaningful(_BARE, vocab.GRAMMAR_WORDS)})) < 3)"
_ADDED = f"list_filter(list_distinct({_meaningful('gold', vocab.COMMON_WORDS)}), lambda w: NOT list_contains({_meaningful('question', vocab.COMMON_WORDS)}, w) AND NOT regexp_matches(w, '^\\d+$'))"
_RESTATES = f"(len({_meaningful('gold', vocab.COMMON_WORDS)}) >= 5 AND len({_ADDED}) < 2)"
_SAME = f"len(list_intersect({tokens('gold')}, {tokens('h2')})) / len(list_distinct(list_concat({tokens('gold')}, {tokens('h2')})))"
_REPEATS = f"(len({tokens('gold')}) > 0 AND len({tokens('h2')}) > 0 AND (contains(lower(trim(h2)), lower(trim(gold))) OR {_SAME} >= 0.8))"
_SUPPORTED = f"(trim(gold) <> '' AND (contains(lower(text), lower(trim(gold))) OR len(list_intersect({tokens('gold')}, {tokens('text')})) / greatest(len({tokens('gold')}), 1) >= 0.6))"


def _attempt(a: int) -> dict[str, str]:
    """CTEs: ``t{a}`` proposes, ``g{a}`` draws golds, ``j{a}`` judges, ``o{a + 1}`` is what goes round again."""
    last = a == attempts.ATTEMPTS - 1
    form = "" if last else f"WHEN {_STRUCTURE} THEN 'structure' WHEN {_LABEL('question')} THEN 'label'"
    e = lambda i: f"e[{i + 1}]"
    first = f"coalesce({e(a)}, e[1])"
    score = f"len(list_intersect({tokens('question')}, {tokens('s')}))"
    return {
        f"t{a}": f"SELECT *, {first} AS target, {_template('query_type', first, f'coalesce({e(a + 1)}, e[2])')} AS question FROM o{a}",
        f"b{a}": f"""SELECT item_id, asked_type, arg_max(trim(s), (n, -i)) AS best FROM (SELECT item_id, asked_type, s, i, {score} AS n FROM (
              SELECT item_id, asked_type, question, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT *, {_SENTS.format('text')} AS ss FROM t{a}))) WHERE n > 0 AND trim(s) <> '' GROUP BY ALL""",
        f"g{a}": f"SELECT t.*, CASE WHEN query_type = 'Unanswerable' THEN 'I don''t know.' ELSE coalesce(best, 'I don''t know.') END AS gold FROM t{a} t LEFT JOIN b{a} USING (item_id, asked_type)",
        f"j{a}": f"""SELECT *, CASE {form} WHEN query_type = 'Unanswerable' THEN NULL WHEN gold = 'I don''t know.' THEN 'ungrounded' WHEN NOT {_SUPPORTED} THEN 'unsupported' WHEN {_LABEL('gold')} THEN 'gold_label'
              WHEN {_CITES} THEN 'citation_only' WHEN {_RESTATES} THEN 'restates' WHEN {_REPEATS} THEN 'repeats' END AS reason FROM g{a}""",
        f"d{a}": f"SELECT item_id, asked_type, query_type, {a + 1}::BIGINT AS attempts, CASE WHEN reason IS NULL THEN reasons ELSE list_append(reasons, reason) END AS reasons, reason IS NOT NULL AS gave_up, question, gold FROM j{a}" + ("" if last else " WHERE reason IS NULL"),
        f"o{a + 1}": f"SELECT item_id, asked_type, text, h1, h2, e, CASE WHEN reason = 'repeats' AND query_type IN {in_(attempts.CIRCLING)} THEN 'Multi-Hop' ELSE query_type END AS query_type, list_append(reasons, reason) AS reasons FROM j{a} WHERE reason IS NOT NULL",
    }


_ALL = {"o0": f"SELECT item_id, k AS asked_type, text, question AS h1, gold AS h2, {_ENTITIES} AS e, k AS query_type, []::VARCHAR[] AS reasons FROM (SELECT *, {_PH.replace('{c}', 'text')} AS ps FROM bench), (SELECT unnest({cq._KINDS}) AS k)"}
for _a in range(attempts.ATTEMPTS):
    _ALL |= _attempt(_a)
_ALL["done"] = " UNION ALL ".join(f"SELECT * FROM d{a}" for a in range(attempts.ATTEMPTS))
_BASE = "CASE query_type " + " ".join(f"WHEN '{t}' THEN {d}" for t, _, _, d in vocab.QUERY_TYPES) + " END::BIGINT"
_W = attempts.WIDER
SQL = {
    "guarded_turns": sql(f"SELECT item_id, asked_type, query_type, attempts, array_to_string(reasons, ',') AS reasons, gave_up, md5(question) AS question_md5, md5(gold) AS gold_md5, {_BASE} AS difficulty FROM done", "bench", more=_ALL, once=True),
    "seed_grounding": sql(
        f"""SELECT item_id, md5(CASE WHEN g IS NOT NULL OR t IS NULL THEN question ELSE {_template("'Topic Shift'", 'about', 'about')} END) AS question_md5,
            CASE WHEN g <= {_W[0]} THEN 0 WHEN g <= {_W[1]} THEN 1 WHEN g <= {_W[2]} THEN 2 END::BIGINT AS attempt, g IS NULL AND t IS NOT NULL AS rewritten, coalesce(gc, t) AS chunk_id
            FROM bench LEFT JOIN (SELECT item_id, min(rank) FILTER (ok) AS g, arg_min(chunk_id, rank) FILTER (ok) AS gc, arg_min(chunk_id, rank) AS t, max({_ENTITIES}[1]) FILTER (rank = 1) AS about FROM ok GROUP BY item_id) USING (item_id)""",
        "hits", "bench",
        more={
            "ok": f"""SELECT item_id, rank, chunk_id, {_PH.replace('{c}', 'text')} AS ps, len(list_filter({_SENTS.format('text')}, lambda s: len(list_intersect(q, {tokens('s')})) / greatest(len(q), 1) >= {attempts.ANSWERABLE})) > 0 AS ok
                FROM (SELECT h.item_id, rank, h.chunk_id, c.text, {tokens('question')} AS q FROM hits h JOIN chunks c USING (chunk_id) JOIN bench b ON b.item_id = h.item_id WHERE rank <= {_W[2]})"""
        },
        once=True,
    ),
}
