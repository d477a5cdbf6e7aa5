"""Retrieval systems and evidence handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.functions import match
from turnlens.functions import text as t
from turnlens.functions import vectors as x
from turnlens.lineage import kept
from turnlens.operators import retrieval as r
from turnlens.plans import text_queries as tq
from turnlens.plans import views as v
from turnlens.plans.oracle import sql, tokens


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every id divisible by 20) and all vectors, those of the queries too."""
    vecs = v.vecs(spark, sf)
    return vecs.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("emb").alias("qemb"), F.col("label").alias("qlabel")), vecs


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    queries, corpus = _vectors(spark, sf)
    return r.dense_topk(queries.select("qid", "qemb"), corpus.select("vec_id", "emb"), 5).select("qid", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


def rerank_stable(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best vectors of a query re-ranked by agreement of labels, then by their first order."""
    queries, corpus = _vectors(spark, sf)
    top = r.dense_topk(queries.select("qid", "qemb"), corpus.select("vec_id", "emb"), 20)
    scored = top.join(corpus.select("vec_id", "label"), "vec_id").join(F.broadcast(queries.select("qid", "qlabel")), "qid")
    w = Window.partitionBy("qid").orderBy(F.desc((F.col("label") == F.col("qlabel")).cast("int")), "rank")
    return scored.withColumn("new", F.row_number().over(w).cast("long")).filter("new <= 5").select("qid", F.col("new").alias("rank"), "vec_id")


def history_queries(spark: SparkSession, sf: str) -> DataFrame:
    """User questions with the two messages before them as the query: qid, question, query, gold."""
    w = Window.partitionBy("conv_id").orderBy("turn_id").rowsBetween(-1, -1)
    last = F.collect_list(F.concat_ws(" ", "question", "gold")).over(w)
    rows = v.qa_turns(spark, sf).select("conv_id", "turn_id", "question", "gold", F.trim(F.concat_ws(" ", F.array_join(last, " "), "question")).alias("query"))
    return rows.withColumn("qid", F.col("conv_id") * 1000 + F.col("turn_id"))


def _system(spark: SparkSession, sf: str, units: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    asked = history_queries(spark, sf)
    return asked, _found(asked, units, k, r.weights(units))


def _found(asked: DataFrame, units: DataFrame, k: int, weights: DataFrame) -> DataFrame:
    """The k best units of each query with their texts, kept: several branches read them."""
    hits = r.unit_topk(asked.select("qid", F.explode(t.token_set(F.col("query"))).alias("token")), r.texts(units), weights, k, query="qid")
    return kept(r.with_texts(hits, units))


def _answered(asked: DataFrame, top: DataFrame) -> DataFrame:
    ans = asked.select("qid", "gold").join(r.extractive(asked, top, "qid"), "qid")
    ids = top.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("c")))), lambda x: x["c"]), ",").alias("docs"))
    return ans.join(ids, "qid", "left").select("qid", F.coalesce("docs", F.lit("")).alias("docs"), F.md5("answer").alias("answer_md5"), match.grade(F.col("gold"), F.col("answer"), F.lit(False)).alias("outcome"))


def vector_rag(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieve five chunks with the conversation's last messages, answer by extraction, grade."""
    return _answered(*_system(spark, sf, v.chunks(spark, sf), 5))


def long_units(chunks: DataFrame, group: int = 5) -> DataFrame:
    units = chunks.groupBy("doc_id", F.floor(F.col("pos") / group).alias("u")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return units.select((F.col("doc_id") * v.CHUNK_STEP + F.col("u")).alias("chunk_id"), "text")


def long_rag(spark: SparkSession, sf: str) -> DataFrame:
    """The same over fewer and longer units: five chunks each, two retrieved."""
    return _answered(*_system(spark, sf, long_units(v.chunks(spark, sf)), 2))


def mock_rag(spark: SparkSession, sf: str) -> DataFrame:
    """A weak system: seeded coins drop the history (0.4) and starve the context to one chunk (0.25)."""
    chunks, asked = v.chunks(spark, sf), history_queries(spark, sf)
    coin = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("qid").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    asked = asked.withColumn("used", coin("history|") > 0.4).withColumn("starved", coin("starve|") < 0.25).withColumn("query", F.when(F.col("used"), F.col("query")).otherwise(F.col("question")))
    hits = r.unit_topk(asked.select("qid", F.explode(t.token_set(F.col("query"))).alias("token")), r.texts(chunks), r.weights(chunks), 3, query="qid")
    top = hits.join(F.broadcast(asked.select("qid", "starved")), "qid").filter("not starved or rank = 1")
    return top.groupBy("qid", "starved").agg(F.count(F.lit(1)).alias("n_docs"), F.min_by("chunk_id", "rank").alias("first")).join(asked.select("qid", "used"), "qid")


def _requery(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, their first five chunks, and five for the question with the first answer added."""
    chunks, bench = v.chunks(spark, sf), v.bench(spark, sf)
    weights = r.weights(chunks)
    find = lambda q: kept(r.with_texts(r.unit_topk(q, r.texts(chunks), weights, 5), chunks))  # noqa: E731  five rows a seed, read by several branches
    first = find(bench.select("item_id", F.explode(t.token_set(F.col("question"))).alias("token")))
    wide = bench.join(r.extractive(bench, first), "item_id").select("item_id", F.explode(t.token_set(F.concat_ws(" ", "question", "answer"))).alias("token"))
    return bench, first, find(wide)


def _merged(a: DataFrame, b: DataFrame, cap: int) -> DataFrame:
    """Ordered union: ``a`` before ``b``, texts once, at most ``cap``, ranked anew."""
    both = a.withColumn("o", F.lit(0)).unionByName(b.withColumn("o", F.lit(1)))
    once = both.groupBy("item_id", "text").agg(F.min(F.struct("o", "rank", "chunk_id")).alias("f")).select("item_id", "text", "f.*")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("o", "rank")))
    return ranked.filter(F.col("rank") <= cap).select("item_id", "rank", "chunk_id", "text")


def union_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    _, first, second = _requery(spark, sf)
    cols = ["item_id", "rank", "chunk_id", "text"]
    return _merged(second.select(cols), first.select(cols), 7).select("item_id", F.col("rank").cast("long").alias("rank"), F.md5("text").alias("text_md5"))


def self_critique_rag(spark: SparkSession, sf: str) -> DataFrame:
    """An answer that shares less than half of its question's tokens is judged unsupported: retrieve again, merge, answer again."""
    bench, first, second = _requery(spark, sf)
    cols = ["item_id", "rank", "chunk_id", "text"]
    one = bench.join(r.extractive(bench, first), "item_id")
    judged = one.select("item_id", "gold", "question", F.col("answer").alias("a1"), (t.share(t.token_set(F.col("question")), t.token_set(F.col("answer"))) >= 0.5).alias("supported"))
    two = r.extractive(bench, _merged(second.select(cols), first.select(cols), 7)).withColumnRenamed("answer", "a2")
    return judged.join(two, "item_id").select("item_id", (~F.col("supported")).alias("reflected"), match.grade(F.col("gold"), F.when(F.col("supported"), F.col("a1")).otherwise(F.col("a2")), F.lit(False)).alias("outcome"))


def corrective_rag(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with a third of the question's tokens are relevant: two or more are kept alone, one is merged with a second search, none is replaced by it."""
    bench, first, second = _requery(spark, sf)
    cols = ["item_id", "rank", "chunk_id", "text"]
    graded = first.join(bench.select("item_id", "question"), "item_id").withColumn("rel", t.share(t.token_set(F.col("question")), t.token_set(F.col("text"))) >= 0.34)
    verdict = graded.groupBy("item_id").agg(F.count_if("rel").alias("n")).select("item_id", F.when(F.col("n") >= 2, "correct").when(F.col("n") == 1, "ambiguous").otherwise("incorrect").alias("verdict"))
    keep = graded.filter("rel").select(cols)
    again = second.join(verdict.filter("verdict <> 'correct'").select("item_id"), "item_id", "left_semi").select(cols)
    docs = _merged(keep, again, 7)
    return docs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min_by("chunk_id", "rank").alias("first")).join(verdict, "item_id")


def doc_id_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of retrieved chunks mapped to names of their documents."""
    names = v.chunks(spark, sf).select("chunk_id", F.format_string("doc-%05d-%02d", "doc_id", "pos").alias("doc_name"))
    return tq.lexical_topk(spark, sf).join(names, "chunk_id").select("item_id", "rank", "doc_name")


def text_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk id that each text resolves to: the last of equal texts."""
    chunks = v.chunks(spark, sf).select("chunk_id", F.md5("text").alias("h"))
    return chunks.groupBy("h").agg(F.max("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def union_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks without repeated texts, by language; the first id stays."""
    lang = v.table(spark, sf, "documents").select("doc_id", "lang")
    once = v.chunks(spark, sf).join(lang, "doc_id").groupBy(F.md5("text").alias("h")).agg(F.min(F.struct("chunk_id", "lang")).alias("m"))
    return once.groupBy("m.lang").agg(F.count(F.lit(1)).alias("n"), F.sum("m.chunk_id").alias("id_sum"))


def doc_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each query's best five vectors to it and to its label's mean vector."""
    queries, corpus = _vectors(spark, sf)
    top = r.dense_topk(queries.select("qid", "qemb"), corpus.select("vec_id", "emb"), 5)
    mean = corpus.select("label", F.posexplode("emb").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    rows = top.join(corpus.select("vec_id", "emb"), "vec_id").join(F.broadcast(queries.select("qid", "qlabel")), "qid").join(F.broadcast(mean), F.col("qlabel") == F.col("label"))  # a row a label
    norm = lambda c: F.sqrt(r.dot(F.col(c), F.col(c)))
    return rows.select("qid", "vec_id", F.col("score").alias("to_question"), F.round(r.dot(F.col("emb"), F.col("mean")) / (norm("emb") * norm("mean") + 1e-9), 6).alias("to_label"))


def evidence_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """For each seed the mean, over one search's chunks, of the best token overlap with another's."""
    _, first, second = _requery(spark, sf)
    pairs = first.select("item_id", F.col("chunk_id").alias("a"), t.token_set(F.col("text")).alias("ta")).join(second.select("item_id", t.token_set(F.col("text")).alias("tb")), "item_id")
    best = pairs.groupBy("item_id", "a").agg(F.max(t.jaccard(F.col("ta"), F.col("tb"))).alias("best"))
    return best.groupBy("item_id").agg(F.round(F.avg("best"), 6).alias("overlap"))


def evidence_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """For each seed the mean, over one search's chunks, of the best cosine to another's.

    The other's few vectors come in one array, so a chunk meets them in its own row and no pair is written.
    """
    _, first, second = _requery(spark, sf)
    vec = lambda c: x.counts(x.codes(F.col(c)))
    other = second.select("item_id", vec("text").alias("v")).groupBy("item_id").agg(F.collect_list("v").alias("others"))
    best = first.select("item_id", vec("text").alias("v")).join(other, "item_id").select("item_id", F.round(F.array_max(F.transform("others", lambda o: x.cosine(F.col("v"), o))), 9).alias("best"))
    return best.groupBy("item_id").agg(F.round(F.avg("best"), 6).alias("overlap"))


def doc_similarity_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each seed's chunks with their cosines to its question, its gold and its answer, the closest to the question first."""
    bench, first, _ = _requery(spark, sf)
    said = bench.join(r.extractive(bench, first), "item_id").select("item_id", *(x.counts(x.codes(F.col(c))).alias(c) for c in ("question", "gold", "answer")))
    rows = first.select("item_id", "chunk_id", x.counts(x.codes(F.col("text"))).alias("v")).join(said, "item_id")
    near = rows.select("item_id", "chunk_id", *(F.round(F.round(x.cosine(F.col(c), F.col("v")), 9), 3).alias(f"to_{c}") for c in ("question", "gold", "answer")))
    w = Window.partitionBy("item_id").orderBy(F.desc("to_question"), "chunk_id")
    return near.withColumn("place", F.row_number().over(w).cast("long"))


QUERIES = {f.__name__: f for f in (
    evidence_cosine, doc_similarity_text, dense_topk, rerank_stable, vector_rag, long_rag, mock_rag, union_dedupe, self_critique_rag, corrective_rag, doc_id_remap, text_resolve, union_corpus, doc_similarity, evidence_overlap,
)}

_DENSE = lambda k: f"""SELECT qid, rank, vec_id, score FROM (SELECT qid, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS qid, c.vec_id, list_dot_product(q.emb, c.emb) AS s FROM vecs q, vecs c WHERE q.vec_id % 20 = 0)) WHERE rank <= {k}"""  # noqa: E731
_HQ = """SELECT conv_id * 1000 + turn_id AS qid, question, gold, trim(concat_ws(' ', coalesce(p, ''), question)) AS query FROM (
      SELECT *, lag(question || ' ' || gold) OVER (PARTITION BY conv_id ORDER BY turn_id) AS p FROM qa_turns)"""


def _search(name: str, queries: str, text: str, key: str, units: str, k: int) -> dict[str, str]:
    """CTEs: ``name`` holds the k best units of each query."""
    return {
        f"{name}_p": f"SELECT chunk_id, unnest({tokens('text')}) AS token FROM {units}",
        f"{name}_i": f"SELECT token, ln(((SELECT count(*) FROM {units}) + 1) / (count(*) + 1)) + 1 AS idf FROM {name}_p GROUP BY token",
        f"{name}_q": f"SELECT {key}, unnest({tokens(text)}) AS token FROM {queries}",
        name: f"""SELECT {key}, rank, chunk_id, text FROM (SELECT {key}, chunk_id, row_number() OVER (PARTITION BY {key} ORDER BY round(s, 9) DESC, chunk_id DESC) AS rank FROM (
              SELECT {key}, chunk_id, sum(idf) AS s FROM {name}_q JOIN {name}_p USING (token) JOIN {name}_i USING (token) GROUP BY ALL)) JOIN {units} USING (chunk_id) WHERE rank <= {k}""",
    }


def _extract(name: str, questions: str, top: str, key: str) -> dict[str, str]:
    """CTE ``name``: the extractive answer of each question from the texts of ``top``."""
    score = f"len(list_intersect(q, {tokens('sent')}))"
    return {
        name: f"""SELECT b.{key}, coalesce(nullif(a.answer, ''), f.text, 'I don''t know.') AS answer FROM {questions} b
          LEFT JOIN (SELECT {key}, answer FROM (SELECT {key}, trim(sent) AS answer, {score} AS score, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, rank, spos) AS rn FROM (
            SELECT {key}, {tokens('question')} AS q, rank, unnest(ss) AS sent, generate_subscripts(ss, 1) AS spos FROM (SELECT {key}, question, rank, string_split(regexp_replace(t.text, '([.!?])[ \\t\\n\\f\\r]+', '\\1␞', 'g'), '␞') AS ss FROM {top} t JOIN {questions} USING ({key}))))
            WHERE rn = 1 AND score > 0) a USING ({key}) LEFT JOIN (SELECT {key}, arg_min(substring(text, 1, 200), rank) AS text FROM {top} GROUP BY {key}) f ON f.{key} = b.{key}"""
    }


def _rag(units: str, k: int, more: dict[str, str] | None = None) -> str:
    return sql(
        f"""SELECT qid, coalesce(docs, '') AS docs, md5(answer) AS answer_md5, {tq._GRADE.format(a='answer', g='gold', u='false')} AS outcome FROM hq JOIN ans USING (qid)
            LEFT JOIN (SELECT qid, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS docs FROM top GROUP BY qid) USING (qid)""",
        "qa_turns", "chunks", more={"hq": _HQ, **(more or {}), **_search("top", "hq", "query", "qid", units, k), **_extract("ans", "hq", "top", "qid")},
    )


_AGAIN = {"wq": "SELECT item_id, question, question || ' ' || answer AS query FROM answers", **_search("t2", "wq", "query", "item_id", "chunks", 5)}
_MERGE = lambda a, b: f"""SELECT item_id, rank, chunk_id, text FROM (SELECT item_id, text, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY o, rank) AS rank FROM (
      SELECT item_id, text, arg_min(chunk_id, o * 100 + rank) AS chunk_id, min(o * 100 + rank) // 100 AS o, min(o * 100 + rank) % 100 AS rank FROM (SELECT 0 AS o, item_id, rank, chunk_id, text FROM {a} UNION ALL SELECT 1, item_id, rank, chunk_id, text FROM {b}) GROUP BY item_id, text)) WHERE rank <= 7"""  # noqa: E731
_COIN = lambda s: f"(('0x' || substring(md5('{s}|' || qid), 1, 8))::UBIGINT / 4294967296.0)"
_JAC = lambda a, b: f"CASE WHEN len({tokens(a)}) = 0 OR len({tokens(b)}) = 0 THEN 0.0 ELSE len(list_intersect({tokens(a)}, {tokens(b)})) / len(list_distinct(list_concat({tokens(a)}, {tokens(b)}))) END"
SQL = {
    "dense_topk": sql(_DENSE(5), "vecs"),
    "rerank_stable": sql(
        f"SELECT qid, new AS rank, vec_id FROM (SELECT t.qid, t.vec_id, row_number() OVER (PARTITION BY t.qid ORDER BY (c.label = q.label)::INT DESC, t.rank) AS new FROM t JOIN vecs c USING (vec_id) JOIN vecs q ON q.vec_id = t.qid) WHERE new <= 5", "vecs", more={"t": _DENSE(20)}
    ),
    "vector_rag": _rag("chunks", 5),
    "long_rag": _rag("units", 2, {"units": "SELECT doc_id * 1048576 + pos // 5 AS chunk_id, string_agg(text, E'\\n' ORDER BY pos) AS text FROM chunks GROUP BY doc_id, pos // 5"}),
    "mock_rag": sql(
        "SELECT qid, starved, used, count(*) AS n_docs, arg_min(chunk_id, rank) AS first FROM top JOIN mq USING (qid) WHERE NOT starved OR rank = 1 GROUP BY qid, starved, used",
        "qa_turns", "chunks", more={"hq": _HQ, "mq": f"SELECT qid, {_COIN('history')} > 0.4 AS used, {_COIN('starve')} < 0.25 AS starved, CASE WHEN {_COIN('history')} > 0.4 THEN query ELSE question END AS query FROM hq", **_search("top", "mq", "query", "qid", "chunks", 3)},
    ),
    "union_dedupe": sql("SELECT item_id, rank, md5(text) AS text_md5 FROM m", "answers", more={**_AGAIN, "m": _MERGE("t2", "top5")}),
    "self_critique_rag": sql(
        f"""SELECT item_id, NOT ok AS reflected, {tq._GRADE.format(a='a', g='gold', u='false')} AS outcome FROM (SELECT item_id, gold, ok, CASE WHEN ok THEN a1 ELSE a2.answer END AS a FROM (
              SELECT item_id, gold, answer AS a1, len(list_intersect({tokens('question')}, {tokens('answer')})) / len({tokens('question')}) >= 0.5 AS ok FROM answers) JOIN a2 USING (item_id))""",
        "answers", more={**_AGAIN, "m": _MERGE("t2", "top5"), **_extract("a2", "bench", "m", "item_id")},
    ),
    "corrective_rag": sql(
        "SELECT item_id, verdict, count(*) AS n_docs, arg_min(chunk_id, rank) AS first FROM m JOIN vd USING (item_id) GROUP BY item_id, verdict",
        "answers",
        more={
            **_AGAIN,
            "gr": f"SELECT item_id, rank, chunk_id, t.text, len(list_intersect({tokens('question')}, {tokens('t.text')})) / len({tokens('question')}) >= 0.34 AS rel FROM top5 t JOIN bench USING (item_id)",
            "vd": "SELECT item_id, CASE WHEN count(*) FILTER (rel) >= 2 THEN 'correct' WHEN count(*) FILTER (rel) = 1 THEN 'ambiguous' ELSE 'incorrect' END AS verdict FROM gr GROUP BY item_id",
            "kept": "SELECT * FROM gr WHERE rel", "more2": "SELECT t2.* FROM t2 JOIN vd USING (item_id) WHERE verdict <> 'correct'", "m": _MERGE("kept", "more2"),
        },
    ),
    "doc_id_remap": sql("SELECT item_id, rank, format('doc-{:05d}-{:02d}', doc_id, pos) AS doc_name FROM top5 JOIN chunks USING (chunk_id)", "top5"),
    "text_resolve": sql("SELECT md5(text) AS h, max(chunk_id) AS chunk_id, count(*) AS n FROM chunks GROUP BY text HAVING count(*) > 1", "chunks"),
    "union_corpus": sql("SELECT lang, count(*) AS n, sum(chunk_id)::BIGINT AS id_sum FROM (SELECT min(chunk_id) AS chunk_id FROM chunks GROUP BY text) JOIN chunks USING (chunk_id) JOIN documents USING (doc_id) GROUP BY lang", "chunks"),
    "doc_similarity": sql(
        """SELECT qid, vec_id, score AS to_question, round(list_dot_product(c.emb, mean) / (sqrt(list_dot_product(c.emb, c.emb)) * sqrt(list_dot_product(mean, mean)) + 1e-9), 6) AS to_label FROM t JOIN vecs c USING (vec_id) JOIN vecs q ON q.vec_id = qid JOIN mn ON mn.label = q.label""",
        "vecs", more={"t": _DENSE(5), "mn": "SELECT label, list(x ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM vecs) GROUP BY ALL) GROUP BY label"},
    ),
    "evidence_overlap": sql(f"SELECT item_id, round(avg(best), 6) AS overlap FROM (SELECT a.item_id, a.chunk_id, max({_JAC('a.text', 'b.text')}) AS best FROM top5 a JOIN t2 b USING (item_id) GROUP BY ALL) GROUP BY item_id", "answers", more=_AGAIN),
}


def _vectors_sql(name: str, rows: str, key: str, text: str) -> dict[str, str]:
    """CTEs: ``name`` has (key, d, v), the hashed vector of each text, and ``{name}_n`` its length."""
    digit = lambda i: f"(strpos('0123456789abcdef', substring(m, {i}, 1)) - 1)"
    return {
        name: f"""SELECT {key}, {digit(1)} * 16 + {digit(2)} + 1 AS d, sum(CASE WHEN substring(m, 3, 1) < '8' THEN 1 ELSE -1 END) AS v FROM (
            SELECT {key}, md5(unnest(list_filter({tokens(text)}, lambda t: length(t) >= {x.TOKEN_CHARS}))) AS m FROM {rows}) GROUP BY ALL""",
        f"{name}_n": f"SELECT {key}, sqrt(sum(v * v)) AS n FROM {name} GROUP BY {key}",
    }


_COS = lambda a, b, on: f"coalesce((SELECT sum(p.v * q.v) FROM {a} p JOIN {b} q USING (d) WHERE {on}), 0) / (coalesce((SELECT n FROM {a}_n p WHERE {on.split(' AND ')[0]}), 0) * coalesce((SELECT n FROM {b}_n q WHERE {on.split(' AND ')[1]}), 0) + 1e-9)"
_CHUNK_V = {**_AGAIN, "used": "SELECT DISTINCT chunk_id, text FROM (SELECT chunk_id, text FROM top5 UNION ALL SELECT chunk_id, text FROM t2)", **_vectors_sql("cv", "used", "chunk_id", "text")}
SQL["evidence_cosine"] = sql(
    f"""SELECT item_id, round(avg(best), 6) AS overlap FROM (SELECT item_id, a, max(round(c, 9)) AS best FROM (
          SELECT x.item_id, x.chunk_id AS a, {_COS('cv', 'cv', 'p.chunk_id = x.chunk_id AND q.chunk_id = y.chunk_id')} AS c FROM top5 x JOIN t2 y USING (item_id)) GROUP BY ALL) GROUP BY item_id""",
    "answers", more=_CHUNK_V, once=True,
)
_TO = lambda c: f"round(round({_COS(c, 'cv', 'p.item_id = x.item_id AND q.chunk_id = x.chunk_id')}, 9), 3)"
SQL["doc_similarity_text"] = sql(
    f"""SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY to_question DESC, chunk_id) AS place FROM (
          SELECT x.item_id, x.chunk_id, {_TO('qv')} AS to_question, {_TO('gv')} AS to_gold, {_TO('av')} AS to_answer FROM top5 x)""",
    "answers", more={**_CHUNK_V, **_vectors_sql("qv", "answers", "item_id", "question"), **_vectors_sql("gv", "answers", "item_id", "gold"), **_vectors_sql("av", "answers", "item_id", "answer")}, once=True,
)
