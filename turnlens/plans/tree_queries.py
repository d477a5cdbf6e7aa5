"""The tree of summaries over the corpus, and search over all of its levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.functions import vectors
from turnlens.lineage import kept
from turnlens.operators import systems, tree
from turnlens.plans import retrieval_queries as rq
from turnlens.plans import views as v
from turnlens.plans.oracle import sql, tokens


def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the tree over all chunks: its level, its parent and its text."""
    return tree.build(v.chunks(spark, sf)).select("node_id", F.col("level").cast("long").alias("level"), "parent", F.md5("text").alias("text_md5"))


def tree_rag(spark: SparkSession, sf: str) -> DataFrame:
    """Five nodes of any level for each seed, and the answer from them."""
    nodes = kept(tree.build(v.chunks(spark, sf)))
    asked = v.bench(spark, sf).select(F.col("item_id").alias("qid"), "question", F.col("question").alias("query"))
    got = systems.connect("tree")(asked, tree.pool(nodes), k=5, built=True)
    docs = got.select(F.col("qid").alias("item_id"), F.md5("answer").alias("answer_md5"), F.explode("docs").alias("d"))
    levels = nodes.select(F.col("node_id").alias("id"), F.col("level").cast("long").alias("level"))
    return docs.join(levels, F.col("d.chunk_id") == F.col("id")).select("item_id", F.col("d.rank").cast("long").alias("rank"), F.col("id").alias("node_id"), "level", F.col("d.score").alias("score"), "answer_md5")


QUERIES = {f.__name__: f for f in (tree_nodes, tree_rag)}


def _digit(place: int) -> str:
    return f"(strpos('0123456789abcdef', substring(m, {place}, 1)) - 1)"


_FIRST = f"substring(trim(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\f\\r]+', '\\1␞', 'g'), '␞')[1]), 1, {tree.QUOTE_CHARS})"


def _level(i: int) -> dict[str, str]:
    """CTEs that cluster the nodes of ``l{i}`` and make ``l{i + 1}`` of them; all are empty where the level is the top."""
    assign = lambda r: f"""SELECT node_id, c, s FROM (SELECT node_id, c, s, row_number() OVER (PARTITION BY node_id ORDER BY s DESC, c) AS rn FROM (
          SELECT n.node_id, k.c, round(coalesce(t.s, 0), 9) AS s FROM l{i} n, (SELECT unnest(range(k)) AS c FROM k{i}) k
          LEFT JOIN (SELECT node_id, c, sum(sign * w) AS s FROM x{i} JOIN w{i}_{r} USING (d) GROUP BY ALL) t ON t.node_id = n.node_id AND t.c = k.c)) WHERE rn = 1"""  # noqa: E731
    sums = lambda name, rows: {
        f"{name}s": f"SELECT c, d, sum(sign / sqrt(n)) AS s FROM x{i} JOIN {rows} USING (node_id) GROUP BY ALL",
        f"{name}n": f"SELECT c, sqrt(sum(s * s)) AS len FROM {name}s GROUP BY c HAVING sqrt(sum(s * s)) > 0",
    }
    out = {
        f"k{i}": f"SELECT CASE WHEN count(*) <= {tree.FEW} THEN 0 ELSE greatest(2, least(count(*) // {tree.PER_CLUSTER}, {tree.MOST})) END AS k FROM l{i}",
        f"x{i}": f"""SELECT node_id, n, {_digit(1)} * 16 + {_digit(2)} + 1 AS d, CASE WHEN substring(m, 3, 1) < '8' THEN 1 ELSE -1 END AS sign FROM (
            SELECT node_id, len(t) AS n, md5(unnest(t)) AS m FROM (SELECT node_id, list_filter({tokens('text')}, lambda t: length(t) >= {vectors.TOKEN_CHARS}) AS t FROM l{i}), k{i} WHERE k > 0)""",
        f"a{i}_": f"SELECT node_id, c FROM (SELECT node_id, row_number() OVER (ORDER BY md5(node_id::VARCHAR), node_id) - 1 AS c FROM l{i}), k{i} WHERE c < k",
        **sums(f"u{i}_", f"a{i}_"),
        f"w{i}_0": f"SELECT c, d, s / len AS w FROM u{i}_s JOIN u{i}_n USING (c)",
    }
    for r in range(tree.ROUNDS):
        out[f"a{i}_{r}"] = assign(r)
        out |= sums(f"u{i}_{r}", f"a{i}_{r}")
        out[f"w{i}_{r + 1}"] = f"SELECT c, d, s / len AS w FROM u{i}_{r}s JOIN u{i}_{r}n USING (c) UNION ALL SELECT c, d, w FROM w{i}_{r} WHERE c NOT IN (SELECT c FROM u{i}_{r}n)"
    out[f"a{i}"] = assign(tree.ROUNDS)
    out[f"p{i}"] = f"""SELECT node_id, -({(i + 1) * tree.LEVEL_STEP} + c + 1)::BIGINT AS parent, row_number() OVER (PARTITION BY c ORDER BY round(s / sqrt(greatest(n, 1)), 9) DESC, node_id) AS place
        FROM a{i} LEFT JOIN (SELECT node_id, any_value(n) AS n FROM x{i} GROUP BY node_id) USING (node_id)""".replace("greatest(n, 1)", "coalesce(n, 1)")
    out[f"l{i + 1}"] = f"SELECT parent AS node_id, string_agg({_FIRST}, ' ' ORDER BY place) AS text FROM p{i} JOIN l{i} USING (node_id) WHERE place <= {tree.QUOTED} GROUP BY parent"
    return out


_TREE: dict[str, str] = {"l0": "SELECT chunk_id AS node_id, coalesce(text, '') AS text FROM chunks"}
for _i in range(tree.LEVELS):
    _TREE |= _level(_i)
_TREE["nodes"] = " UNION ALL ".join(
    f"SELECT node_id, {i}::BIGINT AS level, {'parent' if i < tree.LEVELS else 'NULL::BIGINT'} AS parent, text FROM l{i}{f' LEFT JOIN p{i} USING (node_id)' if i < tree.LEVELS else ''}" for i in range(tree.LEVELS + 1)
)
_POOL = {**_TREE, "pool": "SELECT node_id AS chunk_id, text FROM nodes"}
SQL = {
    "tree_nodes": sql("SELECT node_id, level, parent, md5(text) AS text_md5 FROM nodes", "chunks", more=_TREE, once=True),
    "tree_rag": sql(
        "SELECT item_id, rank, chunk_id AS node_id, level, round(score, 6) AS score, md5(answer) AS answer_md5 FROM top JOIN scores USING (item_id, chunk_id) JOIN nodes ON node_id = chunk_id JOIN ans USING (item_id)",
        "chunks", "bench",
        more={
            **_POOL, **rq._search("top", "bench", "question", "item_id", "pool", 5), **rq._extract("ans", "bench", "top", "item_id"),
            "scores": "SELECT item_id, chunk_id, sum(idf) AS score FROM top_q JOIN top_p USING (token) JOIN top_i USING (token) GROUP BY ALL",
        },
        once=True,
    ),
}
