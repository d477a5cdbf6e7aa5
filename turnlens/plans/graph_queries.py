"""Entity graphs: extraction, expansion, evidence and personalised PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.functions import text as t
from turnlens.functions import vocab
from turnlens.lineage import kept
from turnlens.operators import graph as g
from turnlens.operators import retrieval as r
from turnlens.plans import text_queries as tq
from turnlens.plans import views as v
from turnlens.plans.oracle import in_, slug, sql

ROUNDS = 3


def _cooc(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extracted chunks, their edges and mentions."""
    e = kept(g.extract(v.chunks(spark, sf)))
    edges = g.edges_of(e)
    return e, edges, g.mentions_of(e, edges)


def entity_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = g.extract(v.chunks(spark, sf))
    return e.select("chunk_id", F.posexplode("ents").alias("pos", "name")).withColumn("pos", F.col("pos").cast("long"))


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return g.collapse(_cooc(spark, sf)[1])


def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes, parallel edges and chunks of the graph."""
    _, edges, mentions = _cooc(spark, sf)
    counts = mentions.agg(F.count_distinct("node_id").alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))  # one row each
    return counts.crossJoin(v.chunks(spark, sf).agg(F.count(F.lit(1)).alias("n_chunks")))


def typed_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """The share of edges with a contentful relation, of the typed graph and of the co-occurrence graph."""
    both = v.kg_edges(spark, sf).select(F.lit("kg").alias("graph"), "relation").unionByName(_cooc(spark, sf)[1].select(F.lit("cooc").alias("graph"), "relation"))
    return both.groupBy("graph").agg(F.round(F.avg((~F.col("relation").isin(*vocab.GENERIC_RELATIONS)).cast("double")), 6).alias("typed_fraction"))


def type_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's first type that is not Other, in order of appearance."""
    nodes = v.kg_nodes(spark, sf)
    seen = nodes.select("id", F.lit("Other").alias("type"), F.lit(0).alias("pos")).unionByName(nodes.filter(F.length("entity") % 3 != 0).select("id", "type", F.lit(1).alias("pos")))
    return seen.groupBy("id").agg(F.min_by("type", F.struct((F.col("type") == "Other").alias("o"), "pos", "type")).alias("type"))


def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes one and two hops from each region, by hop."""
    edges = v.kg_edges(spark, sf)
    start = v.kg_nodes(spark, sf).filter("type = 'region'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    one = g.neighbours(start, edges, "seed")
    two = g.neighbours(one, edges, "seed").join(start, ["seed", "node"], "left_anti")
    return one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2))).groupBy("seed", "hop").agg(F.count(F.lit(1)).alias("n")).withColumn("hop", F.col("hop").cast("long"))


def edge_support(spark: SparkSession, sf: str) -> DataFrame:
    """How many chunks mention both ends of each edge, and the first of them; of all entities of a chunk."""
    return g.supported(kept(g.listed(v.chunks(spark, sf))))


def bridge_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Two-hop paths of distinct ends with a contentful hop; the first middle of each pair of ends."""
    e = v.kg_edges(spark, sf)
    one, two = e.select(F.col("source").alias("a"), F.col("relation").alias("r1"), F.col("target").alias("b")), e.select(F.col("source").alias("b"), F.col("relation").alias("r2"), F.col("target").alias("c"))
    vac = lambda c: F.col(c).isin(*vocab.VACUOUS_RELATIONS)
    paths = one.join(two, "b").filter((F.col("a") != F.col("b")) & (F.col("c") != F.col("a")) & (F.col("c") != F.col("b")) & ~(vac("r1") & vac("r2")))
    return paths.groupBy("a", "c").agg(F.min(F.struct("b", "r1", "r2")).alias("m")).select("a", "m.r1", "m.b", "m.r2", "c")


def comparable_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """For each contentful relation and target type the first two sources, to compare."""
    e = v.kg_edges(spark, sf).filter(~F.col("relation").isin(*vocab.VACUOUS_RELATIONS)).groupBy("relation", "source").agg(F.min("target").alias("target"))
    w = Window.partitionBy("relation").orderBy("source")
    two = e.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").groupBy("relation").agg(F.array_sort(F.collect_list(F.struct("rn", "source", "target"))).alias("x")).filter(F.size("x") == 2)
    return two.select("relation", F.col("x")[0]["source"].alias("s1"), F.col("x")[0]["target"].alias("t1"), F.col("x")[1]["source"].alias("s2"), F.col("x")[1]["target"].alias("t2"))


def entity_linking(spark: SparkSession, sf: str) -> DataFrame:
    """Names linked to nodes: exactly, or else by containing or being contained (names of three characters at least)."""
    nodes = v.kg_nodes(spark, sf).filter("type in ('region', 'nation')").select(F.lower("entity").alias("name"), "id")  # a few dozen rows: broadcast below
    asked = v.table(spark, sf, "nation").select(F.lower(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.substring("n_name", 1, 4))).alias("asked")).distinct()
    exact = asked.join(F.broadcast(nodes), F.col("asked") == F.col("name")).select("asked", "id", F.lit(True).alias("exact"))
    rest = asked.join(exact, "asked", "left_anti")
    loose = rest.join(F.broadcast(nodes), (F.length("name") >= 3) & (F.col("name").contains(F.col("asked")) | F.col("asked").contains(F.col("name"))))
    return exact.unionByName(loose.select("asked", "id", F.lit(False).alias("exact")))


#: Passages of a question among which its five best candidates are sought first.
DEEP = 200


def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical seeds, their entities' neighbours' chunks, and the five best of all by the same score."""
    chunks, bench = v.chunks(spark, sf), v.bench(spark, sf)
    weights, texts = r.weights(chunks), r.texts(chunks)
    asked = kept(bench.select("item_id", F.explode(t.token_set(F.col("question"))).alias("token")))
    seeds = r.unit_topk(asked, texts, weights, 3).select("item_id", "chunk_id")
    _, edges, mentions = _cooc(spark, sf)
    edges, mentions = kept(edges), kept(mentions)
    start = kept(seeds.join(mentions, "chunk_id").select("item_id", F.col("node_id").alias("node")).distinct())
    near = kept(g.neighbours(start, edges, "item_id").select("item_id", "node").distinct())
    # The best of all passages in the same order: where five candidates are among a question's first DEEP, they are the
    # five best candidates, and so are those found where fewer passages share a token with it at all.
    deep = kept(r.unit_topk(asked, texts, weights, DEEP, ties="asc"))
    of = mentions.join(F.broadcast(deep.select("chunk_id").distinct()), "chunk_id", "left_semi").withColumnRenamed("node_id", "node")
    met = deep.join(of, "chunk_id").join(near, ["item_id", "node"], "left_semi").select("item_id", "chunk_id").unionByName(seeds).distinct()
    first = kept(deep.join(met, ["item_id", "chunk_id"]).select("item_id", "chunk_id", "score", F.row_number().over(Window.partitionBy("item_id").orderBy("rank")).cast("long").alias("rank")).filter("rank <= 5"))
    done = first.groupBy("item_id").agg(F.max("rank").alias("n")).filter("n = 5").select("item_id").unionByName(deep.groupBy("item_id").agg(F.max("rank").alias("n")).filter(F.col("n") < DEEP).select("item_id")).distinct()
    # the other questions, whose candidates are rare among the best passages, score each of their own
    left = kept(deep.select("item_id").distinct().join(done, "item_id", "left_anti"))
    out = first.join(left, "item_id", "left_anti").select("item_id", "rank", "chunk_id", "score")
    if left.isEmpty():
        return out
    wide = near.join(left, "item_id").join(mentions, near["node"] == mentions["node_id"]).select("item_id", "chunk_id")
    cand = kept(seeds.join(left, "item_id", "left_semi").unionByName(wide).distinct())
    post = v.postings(chunks.join(cand.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    scored = cand.join(post, "chunk_id").join(asked, ["item_id", "token"]).join(weights, "token").groupBy("item_id", "chunk_id").agg(F.sum("idf").alias("s"))
    w = Window.partitionBy("item_id").orderBy(F.round("s", 9).desc(), F.col("chunk_id"))
    rest = scored.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("item_id", "rank", "chunk_id", F.round("s", 6).alias("score"))
    return out.unionByName(rest)


def ppr_fixed_iter(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds of personalised PageRank from the suppliers."""
    nodes = v.kg_nodes(spark, sf)
    seeds = nodes.filter("type = 'supplier'").select(F.col("id").alias("node"))
    rank = g.pagerank(nodes.select(F.col("id").alias("node")), v.kg_edges(spark, sf), seeds, ROUNDS)
    return rank.select("node", F.round("rank", 9).alias("rank"))


VERIFY = 200


def graph_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of both graphs in seeded order until VERIFY were judged; one without a shared chunk cannot be.

    The scan ends at the key of the last edge to judge, found by a top-k.
    """
    _, cooc, mentions = _cooc(spark, sf)
    edges = cooc.select("source", "target").distinct().unionByName(v.kg_edges(spark, sf).select("source", "target").distinct()).distinct()
    shared = g.support(edges, mentions).select("source", "target").distinct().withColumn("ok", (F.length("source") + F.length("target")) % 4 != 0)
    keyed = edges.join(shared, ["source", "target"], "left").withColumn("key", F.md5(F.concat_ws("|", "source", "target")))
    stop = keyed.filter("ok is not null").orderBy("key").limit(VERIFY).agg(F.max("key").alias("stop"))
    seen = keyed.join(F.broadcast(stop), F.col("key") <= F.col("stop"))  # stop is one row
    n, good = F.count("ok"), F.count_if("ok")
    return seen.agg(n.alias("n_verified"), F.count_if(F.col("ok").isNull()).alias("n_unverifiable"), good.alias("supported"), F.round(good / F.when(n > 0, n), 6).alias("accuracy"))


QUERIES = {f.__name__: f for f in (
    graph_accuracy, entity_extract, graph_edges, graph_stats, typed_fraction, type_promotion, neighbourhood, edge_support, bridge_paths, comparable_pairs, entity_linking, hybrid_retrieve, ppr_fixed_iter,
)}

_EDGE = "(?:^|[^\\p{L}\\p{N}_])"
_COOC = {
    # separators are doubled, so that one can end a phrase and start the next
    "ph": f"""SELECT chunk_id, list_transform(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '{_EDGE}([A-Z][a-zA-Z0-9]+(?:\\s+(?:of|the|de|van|von)?\\s*[A-Z][a-zA-Z0-9]+)*)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1),
        lambda p: replace(p, '  ', ' ')) AS ps FROM chunks""",
    "gd": f"SELECT chunk_id, list_filter(ps, lambda p: string_split(p, ' ')[1] NOT IN {in_(tuple(vocab.STOP_CAPITALS))} AND length(p) >= 3) AS ps FROM ph",
    "en": "SELECT chunk_id, list_filter(ps, lambda p, i: list_position(list_transform(ps, lambda q: lower(q)), lower(p)) = i) AS ps FROM gd",
    "ents": "SELECT chunk_id, unnest(ps[1:12]) AS name, generate_subscripts(ps[1:12], 1) - 1 AS pos FROM en",
    "links": "SELECT chunk_id, unnest(ps[1:12]) AS a, unnest(ps[2:13]) AS b FROM en WHERE len(ps) > 1",
    "ed": f"SELECT * FROM (SELECT {slug('a')} AS source, {slug('b')} AS target, 'co_occurs_with' AS relation, chunk_id FROM links WHERE a IS NOT NULL AND b IS NOT NULL) WHERE source <> target",
    "mn": f"SELECT DISTINCT * FROM (SELECT {slug('name')} AS node_id, chunk_id FROM ents UNION ALL SELECT source, chunk_id FROM ed UNION ALL SELECT target, chunk_id FROM ed)",
}
#: The same over all entities of a chunk.
_WHOLE = {**_COOC, **{n: _COOC[n].replace("[1:12]", "").replace("[2:13]", "[2:]") for n in ("ents", "links")}}
_c = lambda body, *views, cooc=_COOC: sql(body, "chunks", *views, more=cooc)
_ppr = {
    "og": "SELECT source, count(*) AS degree FROM kg_edges GROUP BY source",
    "lk": "SELECT source, target, count(*) / any_value(degree) AS share FROM kg_edges JOIN og USING (source) GROUP BY source, target",
    "r0": "SELECT id AS node, CASE WHEN type = 'supplier' THEN 1.0 / (SELECT count(*) FROM kg_nodes WHERE type = 'supplier') ELSE 0.0 END::DOUBLE AS p, EXISTS (SELECT 1 FROM og WHERE source = id) AS has_out, (CASE WHEN type = 'supplier' THEN 1.0 / (SELECT count(*) FROM kg_nodes WHERE type = 'supplier') ELSE 0.0 END)::DOUBLE AS rank FROM kg_nodes",
    **{
        f"r{i}": f"""SELECT r.node, p, has_out, 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank) FILTER (NOT has_out), 0) FROM r{i - 1}) * p) + 0.15 * p AS rank FROM r{i - 1} r
            LEFT JOIN (SELECT target AS node, sum(share * rank) AS got FROM lk JOIN r{i - 1} ON node = source GROUP BY target) m ON m.node = r.node"""
        for i in range(1, ROUNDS + 1)
    },
}
SQL = {
    "entity_extract": _c("SELECT chunk_id, pos, name FROM ents"),
    "graph_edges": _c("SELECT source, target, relation, count(*) AS weight FROM ed GROUP BY ALL"),
    "graph_stats": _c("SELECT (SELECT count(DISTINCT node_id) FROM mn) AS n_nodes, (SELECT count(*) FROM ed) AS n_edges, (SELECT count(*) FROM chunks) AS n_chunks"),
    "typed_fraction": _c(f"SELECT graph, round(avg((relation NOT IN {in_(vocab.GENERIC_RELATIONS)})::INT), 6) AS typed_fraction FROM (SELECT 'kg' AS graph, relation FROM kg_edges UNION ALL SELECT 'cooc', relation FROM ed) GROUP BY graph", "kg_edges"),
    "type_promotion": sql("SELECT id, coalesce(min(type) FILTER (length(entity) % 3 <> 0), 'Other') AS type FROM kg_nodes GROUP BY id", "kg_nodes"),
    "neighbourhood": sql(
        """SELECT seed, hop::BIGINT AS hop, count(*) AS n FROM (SELECT seed, node, 1 AS hop FROM one UNION ALL SELECT seed, node, 2 FROM two) GROUP BY ALL""",
        "kg_nodes", "kg_edges",
        more={
            "st": "SELECT id AS seed, id AS node FROM kg_nodes WHERE type = 'region'",
            "one": "SELECT DISTINCT seed, n AS node FROM (SELECT seed, target AS n FROM st JOIN kg_edges ON source = node UNION ALL SELECT seed, source FROM st JOIN kg_edges ON target = node) WHERE n <> seed",
            "two": "SELECT DISTINCT seed, n AS node FROM (SELECT seed, target AS n FROM one JOIN kg_edges ON source = node UNION ALL SELECT seed, source FROM one JOIN kg_edges ON target = node) x WHERE n <> seed AND NOT EXISTS (SELECT 1 FROM one o WHERE o.seed = x.seed AND o.node = x.n)",
        },
    ),
    "edge_support": _c("SELECT source, target, count(*) AS n, min(chunk_id) AS first FROM (SELECT DISTINCT source, target FROM ed) e JOIN mn a ON a.node_id = source JOIN mn b ON b.node_id = target AND b.chunk_id = a.chunk_id GROUP BY source, target".replace("min(chunk_id)", "min(a.chunk_id)"), cooc=_WHOLE),
    "graph_accuracy": _c(
        f"""SELECT count(ok) AS n_verified, count(*) FILTER (ok IS NULL) AS n_unverifiable, count(*) FILTER (ok) AS supported, round(count(*) FILTER (ok) / count(ok), 6) AS accuracy FROM (
              SELECT *, coalesce(sum((ok IS NOT NULL)::INT) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
                SELECT md5(source || '|' || target) AS key, CASE WHEN EXISTS (SELECT 1 FROM mn a JOIN mn b USING (chunk_id) WHERE a.node_id = source AND b.node_id = target) THEN (length(source) + length(target)) % 4 <> 0 END AS ok
                FROM (SELECT source, target FROM ed UNION SELECT source, target FROM kg_edges))) WHERE before < {VERIFY}""",
        "kg_edges",
    ),
    "bridge_paths": sql(
        f"""SELECT a, m.r1, m.b, m.r2, c FROM (SELECT x.source AS a, y.target AS c, min({{'b': x.target, 'r1': x.relation, 'r2': y.relation}}) AS m FROM kg_edges x JOIN kg_edges y ON x.target = y.source
            WHERE x.source <> x.target AND y.target <> x.source AND y.target <> x.target AND NOT (x.relation IN {in_(vocab.VACUOUS_RELATIONS)} AND y.relation IN {in_(vocab.VACUOUS_RELATIONS)}) GROUP BY 1, 2)""",
        "kg_edges",
    ),
    "comparable_pairs": sql(
        """SELECT relation, max(source) FILTER (rn = 1) AS s1, max(target) FILTER (rn = 1) AS t1, max(source) FILTER (rn = 2) AS s2, max(target) FILTER (rn = 2) AS t2 FROM (
             SELECT *, row_number() OVER (PARTITION BY relation ORDER BY source) AS rn FROM (SELECT relation, source, min(target) AS target FROM kg_edges GROUP BY ALL)) GROUP BY relation HAVING count(*) >= 2""",
        "kg_edges",
    ),
    "entity_linking": sql(
        """SELECT asked, id, true AS exact FROM ak JOIN nd ON asked = name UNION ALL SELECT asked, id, false FROM ak JOIN nd ON length(name) >= 3 AND (contains(name, asked) OR contains(asked, name)) WHERE asked NOT IN (SELECT name FROM nd)""",
        "kg_nodes", more={"nd": "SELECT lower(entity) AS name, id FROM kg_nodes WHERE type IN ('region', 'nation')", "ak": "SELECT DISTINCT lower(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE substring(n_name, 1, 4) END) AS asked FROM nation"},
    ),
    "hybrid_retrieve": sql(
        """SELECT item_id, rank, chunk_id, score FROM (SELECT item_id, chunk_id, round(s, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM (
             SELECT item_id, chunk_id, sum(idf) AS s FROM cd JOIN postings USING (chunk_id) JOIN query_tokens USING (item_id, token) JOIN idf USING (token) GROUP BY ALL)) WHERE rank <= 5""",
        "hits",
        more={
            **_COOC, "sd": "SELECT item_id, chunk_id FROM hits WHERE rank <= 3", "st": "SELECT DISTINCT item_id, node_id AS node FROM sd JOIN mn USING (chunk_id)",
            "nb": "SELECT DISTINCT item_id, n FROM (SELECT item_id, target AS n FROM st JOIN ed ON source = node UNION ALL SELECT item_id, source FROM st JOIN ed ON target = node) x WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.item_id = x.item_id AND st.node = x.n)",
            "cd": "SELECT DISTINCT * FROM (SELECT * FROM sd UNION ALL SELECT item_id, chunk_id FROM nb JOIN mn ON node_id = n)",
        },
    ),
    "ppr_fixed_iter": sql(f"SELECT node, round(rank, 9) AS rank FROM r{ROUNDS}", "kg_nodes", "kg_edges", more=_ppr),
}
