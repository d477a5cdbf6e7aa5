"""Rules of the source adapters, over inline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.plans import views as v
from turnlens.sources import qa

#: (id, context as JSON text), and what becomes of it.
_CONTEXTS = (
    (1, None, ()),
    (2, '"one text"', ("one text",)),
    (3, '{"title": ["a"], "sentences": [["x", "y"], ["z"]]}', ("x y", "z")),
    (4, '["plain", ["two", "parts"], {"text": "inner"}, " "]', ("plain", "two parts", "inner")),
    (5, '["", "  "]', ()),
)
_ANSWERS = ((1, True, "x", None, None), (2, False, "free", None, None), (3, False, "", ["a", "b"], None), (4, False, None, [], True), (5, False, None, None, False), (6, False, None, None, None))


def context_coercion(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(i, c) for i, c, _ in _CONTEXTS], "id long, raw string")
    return rows.select("id", F.posexplode(qa.coerce_context(F.col("raw"))).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


def qa_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(_ANSWERS, "id long, unanswerable boolean, free string, spans array<string>, yes_no boolean")
    return rows.select("id", qa.paper_answer(*(F.col(c) for c in ("unanswerable", "free", "spans", "yes_no"))).alias("answer"))


def paragraph_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of all documents after cleaning: how many, and their total length."""
    c = qa.clean_paragraphs(F.col("text"))
    return v.table(spark, sf, "documents").select("doc_id", F.size(c).cast("long").alias("n"), F.aggregate(F.transform(c, lambda p: F.length(p)), F.lit(0), lambda a, x: a + x).cast("long").alias("chars"))


def group_of_four(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "benchmark")
    return qa.group_rows(rows, "item_id", "text").select("g", F.md5(F.array_join("context", "\n")).alias("context_md5"))


def synthetic_cycle(spark: SparkSession, sf: str) -> DataFrame:
    return qa.synthetic(spark, 12).select("id", "question", "answer", F.col("context")[0].alias("context"))


QUERIES = {f.__name__: f for f in (context_coercion, qa_coalesce, paragraph_clean, group_of_four, synthetic_cycle)}

SQL = {
    "context_coercion": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {k}::BIGINT, '{t}')" for i, _, ts in _CONTEXTS for k, t in enumerate(ts)) + ") t(id, pos, text)",
    "qa_coalesce": """SELECT id, CASE WHEN u THEN '' ELSE coalesce(nullif(trim(f), ''), nullif(array_to_string(s, ', '), ''), CASE WHEN y THEN 'Yes' WHEN NOT y THEN 'No' END, '') END AS answer FROM (VALUES
        (1::BIGINT, true, 'x', NULL::VARCHAR[], NULL::BOOLEAN), (2, false, 'free', NULL, NULL), (3, false, '', ['a', 'b'], NULL), (4, false, NULL, [], true), (5, false, NULL, NULL, false), (6, false, NULL, NULL, NULL)) t(id, u, f, s, y)""",
    "paragraph_clean": """SELECT doc_id, len(c) AS n, coalesce(list_sum(list_transform(c, lambda p: length(p))), 0)::BIGINT AS chars FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'),
        lambda p: trim(regexp_replace(regexp_replace(p, '@\\w+', '', 'g'), '[ \\t\\n\\f\\r]{2,}', ' ', 'g'))), lambda p: length(p) > 80)[1:40] AS c FROM documents)""",
    "group_of_four": "SELECT g, md5(string_agg(text, E'\\n' ORDER BY item_id)) AS context_md5 FROM (SELECT *, (row_number() OVER (ORDER BY item_id) - 1) // 4 AS g FROM benchmark) GROUP BY g HAVING count(*) = 4",
    "synthetic_cycle": """SELECT format('syn-{:05d}', i) AS id, q AS question, a AS answer, c AS context FROM range(12) r(i) JOIN (VALUES
        (0, 'Which river crosses the town?', 'The Alder', 'The Alder crosses the town of Brenn below the old mill.'), (1, 'Who founded the museum?', 'Mara Holt', 'Mara Holt founded the museum in the former customs house.'),
        (2, 'When did the bridge open?', 'In 1931', 'The bridge opened in 1931 after four years of work.'), (3, 'What does the mill produce?', 'Paper', 'The mill has produced paper since the flood.'),
        (4, 'Where does the railway end?', 'At Sund', 'The railway ends at Sund, by the harbour.')) t(k, q, a, c) ON i % 5 = k""",
}
