"""The injected-failure study: build cases whose failure is known, and attribute them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions import match, vocab
from turnlens.functions.text import sentences, share, token_set
from turnlens.operators.retrieval import extractive

#: Contexts of other seeds that a seed may use, and of its own.
DISTRACTORS, OWN = 5, 6
#: Share of a question's tokens that a sentence must have for a strict system to answer from it.
GROUNDED = 0.5
#: Sub-questions of a static decomposition.
SUB_QUESTIONS = 6


def distractors(contexts: DataFrame, k: int = DISTRACTORS, own: int = OWN) -> DataFrame:
    """(item_id, d, text): for each seed the first k contexts of other seeds.

    Only the first k + own contexts in order can be among them (a seed has at
    most ``own``), so these few rows are broadcast, not the seeds joined.
    """
    first = contexts.orderBy("item_id", "pos").limit(k + own).select(F.col("item_id").alias("other"), "pos", "text")
    seeds = contexts.select("item_id").distinct()
    met = seeds.join(F.broadcast(first), F.col("item_id") != F.col("other"))
    w = Window.partitionBy("item_id").orderBy("other", "pos")
    return met.withColumn("d", F.row_number().over(w)).filter(F.col("d") <= k).select("item_id", "d", "text")


def near_misses(seeds: DataFrame, contexts: DataFrame, k: int = 3) -> DataFrame:
    """(item_id, d, text): the first own contexts, but for the passage itself, that do not hold the answer."""
    rest = contexts.filter("pos > 0").join(seeds.select("item_id", "answer"), "item_id").filter(~match.contains_answer(F.col("text"), F.col("answer")))
    w = Window.partitionBy("item_id").orderBy("pos")
    return rest.withColumn("d", F.row_number().over(w)).filter(F.col("d") <= k).select("item_id", "d", "text")


def grounding(questions: DataFrame, contexts: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, grounded): the largest share of the question's tokens that one sentence of its context has."""
    asked = questions.select(key, token_set(F.col("question")).alias("_q"))
    each = contexts.join(asked, key).select(key, "_q", F.explode(sentences(F.col("text"))).alias("_s"))
    best = each.groupBy(key).agg(F.max(share(F.col("_q"), token_set(F.col("_s")))).alias("grounded"))
    return questions.select(key).join(best, key, "left").select(key, F.coalesce("grounded", F.lit(0.0)).alias("grounded"))


def absent_detail(question: Column) -> Column:
    """A question for a detail that its passage does not have, without a model."""
    return F.concat(question, F.lit(vocab.ABSENT_DETAIL))


def inject(seeds: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases (case_id, truth, item_id, question, antecedent, referent, gold, passage, unanswerable) and their contexts (case_id, rank, text).

    Retrieval cases get near misses (else distractors) in place of the passage;
    conversation cases a pronoun question without its history, whose last answer is the
    referent. Generation cases ask for a detail that is absent, which is verified: a
    system that answers from its passages only would abstain (GROUNDED).
    """
    far = distractors(contexts)
    near = near_misses(seeds, contexts)
    have = near.select("item_id").distinct()
    name = lambda p: F.concat(F.lit(p), F.format_string("%03d", "item_id"))
    none, no = F.lit(""), F.lit(False)
    ret = seeds.select(name("ret-").alias("case_id"), F.lit("Retrieval").alias("truth"), "item_id", "question", none.alias("antecedent"), none.alias("referent"), F.col("answer").alias("gold"), "passage", no.alias("unanswerable"))
    named = F.concat(F.lit("What is "), F.col("answer"), F.lit(" most associated with there?"))
    con = seeds.select(name("con-").alias("case_id"), F.lit("Conversation").alias("truth"), "item_id", F.lit(vocab.PRONOUN_QUESTION).alias("question"), named.alias("antecedent"), F.trim("answer").alias("referent"), F.col("answer").alias("gold"), "passage", no.alias("unanswerable"))
    gen = seeds.select(name("gen-").alias("case_id"), F.lit("Generation").alias("truth"), "item_id", absent_detail(F.col("question")).alias("question"), none.alias("antecedent"), none.alias("referent"), F.lit(vocab.NO_ANSWER).alias("gold"), none.alias("passage"), F.lit(True).alias("unanswerable"))
    baits = seeds.select(name("gen-").alias("case_id"), F.lit(1).alias("rank"), F.col("passage").alias("text")).unionByName(far.filter("d <= 2").select(name("gen-").alias("case_id"), (F.col("d") + 1).cast("int").alias("rank"), "text"))
    absent = grounding(gen, baits).filter(F.col("grounded") < GROUNDED).select("case_id")
    gen, baits = gen.join(absent, "case_id"), baits.join(absent, "case_id")
    given = near.unionByName(far.filter("d <= 3").join(have, "item_id", "left_anti")).select(name("ret-").alias("case_id"), F.col("d").alias("rank"), "text")
    shown = seeds.select(name("con-").alias("case_id"), F.lit(1).alias("rank"), F.col("passage").alias("text")).unionByName(far.filter("d = 1").select(name("con-").alias("case_id"), F.lit(2).alias("rank"), "text"))
    return ret.unionByName(con).unionByName(gen), given.unionByName(shown).unionByName(baits)


def answered(cases: DataFrame, contexts: DataFrame, question: Column, name: str) -> DataFrame:
    """``cases`` with the extractive answer to ``question`` over ``contexts``."""
    got = extractive(cases.select("case_id", question.alias("question")), contexts, "case_id")
    return cases.join(got.withColumnRenamed("answer", name), "case_id")


def base(recovered: Column, present: Column) -> Column:
    return F.when(recovered | present, "Generation").otherwise("Retrieval")


def sub_questions(cases: DataFrame) -> DataFrame:
    """(case_id, i, kind, question): a question's sentences, the first SUB_QUESTIONS; the first is core, those after it follow up."""
    parts = F.filter(F.transform(sentences(F.col("question")), lambda s: F.trim(s)), lambda s: s != "")
    rows = cases.select("case_id", F.posexplode(F.slice(parts, 1, SUB_QUESTIONS)).alias("i", "question"))
    return rows.select("case_id", F.col("i").cast("long").alias("i"), F.when(F.col("i") == 0, "core").otherwise("follow-up").alias("kind"), "question")


def dynamic(cases: DataFrame, contexts: DataFrame) -> DataFrame:
    """``cases`` (with answer and present) and pred by the probing protocol.

    The named question recovers, or only the history tells the referent: Conversation. The passage
    recovers: Retrieval. A strict system abstains where this one answered: Generation. Else the base rule.
    """
    named = answered(cases, contexts, F.col("antecedent"), "a1")
    gold = answered(named, cases.filter("passage <> ''").select("case_id", F.lit(1).alias("rank"), F.col("passage").alias("text")), F.col("question"), "a2")
    probe = F.format_string(vocab.REFERENT_PROBE, "question")
    history = cases.filter("referent <> ''").select("case_id", F.lit(0).alias("rank"), F.col("referent").alias("text"))
    without = answered(gold, contexts, probe, "r0")
    with_it = answered(without, contexts.unionByName(history), probe, "r1")
    strict = with_it.join(grounding(cases, contexts), "case_id")
    right = match.lexical_correct
    pred = (
        F.when((F.col("antecedent") != "") & right(F.col("gold"), F.col("a1")), "Conversation")
        .when((F.col("referent") != "") & right(F.col("referent"), F.col("r1")) & ~right(F.col("referent"), F.col("r0")), "Conversation")
        .when((F.col("passage") != "") & right(F.col("gold"), F.col("a2")), "Retrieval")
        .when((F.col("grounded") < GROUNDED) & ~match.abstained(F.col("answer")), "Generation")
        .otherwise(base(F.lit(False), F.col("present")))
    )
    return strict.withColumn("pred", pred)
