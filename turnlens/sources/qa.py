"""Question-answer sources. Every reader declares its schema and yields (id, question, answer, context, meta)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.functions import vocab
from turnlens.operators.ordering import numbered


MAX_PARAGRAPHS = 40


def no_meta() -> Column:
    return F.expr("cast(map() as map<string,string>)").alias("meta")


def _sample(id_: Column, question: Column, answer: Column, context: Column, meta: Column | None = None) -> list[Column]:
    strip = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return [id_.cast("string").alias("id"), strip(question).alias("question"), strip(answer).alias("answer"), context.alias("context"), no_meta() if meta is None else meta.alias("meta")]


def not_blank(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array()), lambda x: x.isNotNull() & (F.trim(x) != ""))


def records(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Canonical samples of flat records: fields are renamed, the rest becomes meta; an id defaults to a hash of the row."""
    used = {v for v in fields.values()}
    get = lambda k: F.col(fields[k]) if k in fields and fields[k] in rows.columns else F.lit(None)
    rest = [c for c in rows.columns if c not in used]
    meta = F.map_filter(F.map_from_arrays(F.array(*(F.lit(c) for c in rest)), F.array(*(F.col(c).cast("string") for c in rest))), lambda k, x: x.isNotNull()) if rest else None
    context = get("context")
    if "context" in fields and fields["context"] in rows.columns:
        context = F.array(context) if rows.schema[fields["context"]].dataType.simpleString() == "string" else context
    else:
        context = F.array().cast("array<string>")
    id_ = F.coalesce(get("id").cast("string"), F.xxhash64(*rows.columns).cast("string"))
    return rows.select(*_sample(id_, get("question"), get("answer"), not_blank(context), meta))


def coerce_context(raw: Column) -> Column:
    """A context of unknown shape, as JSON text, to texts.

    null: none; a string: itself; an object with sentences: each group joined
    by spaces; another object: its JSON; a list: by element a string, a joined
    list, an object's text, or JSON. Blank texts go.
    """
    val = F.try_parse_json(raw)
    is_ = lambda prefix: F.schema_of_variant(val).startswith(prefix)
    text = F.try_variant_get(val, "$", "string")
    groups = F.try_variant_get(val, "$.sentences", "array<array<string>>")
    items = F.try_variant_get(val, "$", "array<variant>")

    def one(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return (
            F.when(kind == "STRING", F.try_variant_get(x, "$", "string"))
            .when(kind.startswith("ARRAY"), F.array_join(F.try_variant_get(x, "$", "array<string>"), " "))
            .when(F.try_variant_get(x, "$.text", "string").isNotNull(), F.try_variant_get(x, "$.text", "string"))
            .otherwise(F.to_json(x))
        )

    shaped = (
        F.when(raw.isNull() | val.isNull() & (F.trim(raw) == ""), F.array().cast("array<string>"))
        .when(val.isNull(), F.array(raw))
        .when(is_("STRING"), F.array(text))
        .when(groups.isNotNull(), F.transform(groups, lambda g: F.array_join(g, " ")))
        .when(is_("ARRAY"), F.transform(items, one))
        .otherwise(F.array(raw))
    )
    return not_blank(shaped)


def paper_answer(unanswerable: Column, free: Column, spans: Column, yes_no: Column) -> Column:
    """An answer of a paper's question: none if unanswerable, else free text, spans, or Yes/No."""
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    said = F.coalesce(filled(free), filled(F.array_join(F.coalesce(spans, F.array()), ", ")), F.when(yes_no, "Yes").when(~yes_no, "No"), F.lit(""))
    return F.when(unanswerable, "").otherwise(said)


def evidence_first(paragraphs: Column, evidence: Column) -> Column:
    """Evidence paragraphs moved to the front, the others in order, the first MAX_PARAGRAPHS."""
    ev = F.filter(F.coalesce(evidence, F.array()), lambda e: F.array_contains(paragraphs, e))
    return F.slice(F.concat(ev, F.filter(paragraphs, lambda p: ~F.array_contains(ev, p))), 1, MAX_PARAGRAPHS)


def clean_paragraphs(text: Column, longer_than: int = 80, split: str = "\n+") -> Column:
    """Paragraphs without @names, white space collapsed, long enough, the first MAX_PARAGRAPHS."""
    clean = F.transform(F.split(text, split), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"@\w+", ""), r"[ \t\n\f\r]{2,}", " ")))
    return F.slice(F.filter(clean, lambda p: F.length(p) > longer_than), 1, MAX_PARAGRAPHS)


def group_rows(rows: DataFrame, order: str, text: str, size: int = 4) -> DataFrame:
    """(g, context): every ``size`` consecutive rows; an incomplete last group goes."""
    placed = numbered(rows.select(order, text), order).withColumn("g", F.floor(F.col("rn") / size))
    groups = placed.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("x")).filter(F.size("x") == size)
    return groups.select("g", F.transform("x", lambda s: s[text]).alias("context"))


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of {id, question, answer, meta_info}: each fact line is a context."""
    raw = spark.read.json(path, schema="id string, question string, answer string, meta_info string, area string", multiLine=True)
    return raw.select(*_sample(F.col("id"), F.col("question"), F.col("answer"), not_blank(F.split(F.coalesce("meta_info", F.lit("")), "\n")), F.create_map(F.lit("area"), F.coalesce("area", F.lit("")))))


def papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers with questions: the first answerable question, its evidence in front of the paragraphs."""
    answer = "struct<unanswerable:boolean,free_form_answer:string,extractive_spans:array<string>,yes_no:boolean,evidence:array<string>>"
    schema = f"id string, abstract string, full_text struct<paragraphs:array<array<string>>>, qas struct<question:array<string>,answers:array<struct<answer:array<{answer}>>>>"
    raw = spark.read.json(path, schema=schema)
    body = not_blank(F.concat(F.array("abstract"), F.flatten("full_text.paragraphs")))
    first = F.transform(F.arrays_zip(F.col("qas.question").alias("q"), F.col("qas.answers").alias("a")), lambda x: F.struct(x["q"].alias("q"), F.get(x["a"]["answer"], F.lit(0)).alias("a")))
    text = lambda x: paper_answer(x["a"]["unanswerable"], x["a"]["free_form_answer"], x["a"]["extractive_spans"], x["a"]["yes_no"])
    hit = F.get(F.filter(first, lambda x: F.coalesce(text(x), F.lit("")) != ""), F.lit(0))
    rows = raw.select("id", body.alias("body"), hit.alias("h")).filter("h is not null")
    return rows.select(*_sample(F.col("id"), F.col("h.q"), text(F.col("h")), evidence_first(F.col("body"), F.col("h.a.evidence"))))


def multihop(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.json(path, schema="id string, question string, answer string, paragraphs array<struct<paragraph_text:string,title:string,is_supporting:boolean>>")
    return raw.select(*_sample(F.col("id"), F.col("question"), F.col("answer"), not_blank(F.transform("paragraphs", lambda p: p["paragraph_text"]))))


def corpus_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Lines of {chunks}: one sample each, without question and answer. The id is a hash of the line."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    return raw.select(*_sample(F.xxhash64("value"), F.lit(""), F.lit(""), coerce_context(F.get_json_object("value", "$.chunks"))))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Computing articles, told by their abstracts, as cleaned paragraphs."""
    raw = spark.read.json(path, schema="article string, abstract string")
    hit = F.lower("abstract").rlike("|".join(vocab.COMPUTING))
    rows = raw.filter(hit).select(F.xxhash64("article").alias("id"), clean_paragraphs(F.col("article")).alias("c")).filter(F.size("c") > 0)
    return rows.select(*_sample(F.col("id"), F.lit(""), F.lit(""), F.col("c")))


def doc_qa(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.json(path, schema="question string, answer string, context string, source_doc string")
    rows = raw.withColumn("c", clean_paragraphs(F.col("context"), 60, "\n{2,}")).filter((F.trim("question") != "") & (F.trim("answer") != "") & (F.size("c") > 0))
    return rows.select(*_sample(F.xxhash64("question", "source_doc"), F.col("question"), F.col("answer"), F.col("c"), F.create_map(F.lit("source"), F.coalesce("source_doc", F.lit("")))))


def abstracts(spark: SparkSession, path: str) -> DataFrame:
    """Titles with abstracts of 200 characters or more, four to a sample."""
    raw = spark.read.json(path, schema="title string, abstract string").filter(F.length("abstract") >= 200)
    rows = raw.select(F.xxhash64("title", "abstract").alias("k"), F.concat_ws(". ", "title", "abstract").alias("text"))
    return group_rows(rows, "k", "text").select(*_sample(F.col("g"), F.lit(""), F.lit(""), F.col("context")))


def passages(spark: SparkSession, path: str) -> DataFrame:
    """A passage corpus: (id, text, title) of lines {_id or id, text, title}; blank texts go."""
    raw = spark.read.json(path, schema="_id string, id string, text string, title string")
    return raw.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.coalesce("_id", "id").alias("id"), "text", "title")


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """Five small samples, cycled with ids of their own."""
    base = [
        (0, "Which river crosses the town?", "The Alder", "The Alder crosses the town of Brenn below the old mill."),
        (1, "Who founded the museum?", "Mara Holt", "Mara Holt founded the museum in the former customs house."),
        (2, "When did the bridge open?", "In 1931", "The bridge opened in 1931 after four years of work."),
        (3, "What does the mill produce?", "Paper", "The mill has produced paper since the flood."),
        (4, "Where does the railway end?", "At Sund", "The railway ends at Sund, by the harbour."),
    ]
    rows = spark.createDataFrame(base, "k long, question string, answer string, text string")
    ids = spark.range(n).select("id", (F.col("id") % 5).alias("k"))
    return ids.join(F.broadcast(rows), "k").select(*_sample(F.format_string("syn-%05d", "id"), F.col("question"), F.col("answer"), F.array("text")))


