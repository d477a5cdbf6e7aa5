"""Typed questions that are tried again until no guard objects, and seeds that are grounded before they are used.

An attempt of all open rows is one plan: propose a question, draw its gold from
the evidence, let the guards judge both. Only rows that a guard rejects go into
the next attempt, with the reason in hand; after the last one they are given
up. Rows in flight are kept in the checkpoint folder, so an attempt is computed
once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.functions import guards, match, vocab
from turnlens.functions.text import sentences, share, token_set
from turnlens.lineage import kept
from turnlens.operators import control

ATTEMPTS = 3
#: Types that refer back by a pronoun; types that a repeated answer turns into another.
BY_PRONOUN = ("Follow-Up", "Ambiguous Reference")
CIRCLING = ("Ambiguous Reference", "Follow-Up", "Clarification", "Correction")
#: Passages among which a seed's answer is looked for, attempt by attempt, and the share of its question that a sentence must have.
WIDER, ANSWERABLE = (8, 16, 24), 0.5

#: (rows with attempt and reason) -> the same rows with question, target and, from a model, difficulty.
Proposer = Callable[[DataFrame], DataFrame]


def answer_from(question: Column, passages: Column) -> Column:
    """The first of the sentences that share most tokens with the question; the abstention where none shares any."""
    q = token_set(question)
    every = F.flatten(F.transform(passages, lambda p: F.transform(sentences(p), lambda s: F.struct(F.size(F.array_intersect(q, token_set(s))).alias("n"), F.trim(s).alias("s")))))
    return F.aggregate(every, F.struct(F.lit(0).alias("n"), F.lit(vocab.NO_ANSWER).alias("s")), lambda a, x: F.when((x["n"] > a["n"]) & (x["s"] != ""), x).otherwise(a))["s"]


def structure_fault(kind: Column, question: Column, target: Column, history: Column) -> Column:
    """A pronoun type without a pronoun, or that names its target; a clarification of nothing that was said."""
    names = (F.coalesce(F.trim(target), F.lit("")) != "") & F.lower(question).contains(F.lower(F.trim(target)))
    words = lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))
    own, said = F.array_except(words(question), F.array(*(F.lit(w) for w in vocab.CLARIFY_WORDS))), words(F.array_join(history, " "))
    unrelated = (F.size(own) > 0) & (F.size(said) > 0) & ~F.arrays_overlap(own, said)
    return F.when(kind.isin(*BY_PRONOUN), ~guards.has_pronoun(question) | names).when(kind == "Clarification", unrelated).otherwise(False)


def objection(last: bool, strict: bool = True) -> Column:
    """The first guard that objects to a row (query_type, question, target, gold, history, answers, evidence), or null.

    An unanswerable question is judged by its form only. In the last attempt
    its form is let pass.
    """
    kind, question, gold = F.col("query_type"), F.col("question"), F.col("gold")
    none = kind == "Unanswerable"
    form = [(structure_fault(kind, question, F.col("target"), F.col("history")), "structure"), (guards.latex_label(question), "label")]
    told = [(gold == vocab.NO_ANSWER, "ungrounded")]
    if strict:
        told.append((~F.exists("evidence", lambda p: match.contains_answer(p, gold)), "unsupported"))
    told += [(guards.latex_label(gold), "gold_label"), (guards.citation_only(gold), "citation_only"), (guards.restates(question, gold), "restates"), (guards.repeats(gold, F.col("answers")), "repeats")]
    out = F.lit(None).cast("string")
    for bad, name in reversed(told):
        out = F.when(~none & bad, name).otherwise(out)
    for bad, name in reversed([] if last else form):
        out = F.when(bad, name).otherwise(out)
    return out


def from_templates(rows: DataFrame) -> DataFrame:
    """Without a model: the type's template about the passage's next two entities in every attempt."""
    at = lambda i: F.get("entities", i)
    first = F.coalesce(at(F.col("attempt")), at(F.lit(0)))
    return rows.withColumn("target", first).withColumn("question", control.template(F.col("query_type"), first, F.coalesce(at(F.col("attempt") + 1), at(F.lit(1)))))


def typed(rows: DataFrame) -> DataFrame:
    """``rows`` with what their type tests, what it may expose, and a difficulty of 1 to 5: the proposer's (``proposed``), or the type's own. Unknown types are an error."""
    spec = rows.sparkSession.createDataFrame(vocab.QUERY_TYPES, "query_type string, capability string, expected_failure string, base int")
    d = F.coalesce("proposed", F.lit(0))
    known = rows.join(F.broadcast(spec), "query_type", "left")
    checked = F.when(F.col("base").isNull(), F.raise_error(F.concat(F.lit("unknown type "), F.coalesce("query_type", F.lit("null"))))).otherwise(F.when(d == 0, F.col("base")).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), d))))
    return known.withColumn("difficulty", checked.cast("int")).drop("base")


def generated(rows: DataFrame, propose: Proposer = from_templates, attempts: int = ATTEMPTS, strict: bool = True, forced: bool = False) -> DataFrame:
    """``rows`` (qid, query_type, entities, history, answers, evidence) with question, target, gold, attempts, reasons and gave_up.

    ``reasons`` has the objection of each attempt that was rejected. A type that
    goes round in circles becomes Multi-Hop for the next attempt, unless types
    are forced; ``asked_type`` is what was asked for.
    """
    open_ = rows.withColumn("asked_type", F.col("query_type")).withColumn("reasons", F.expr("cast(array() as array<string>)")).withColumn("reason", F.lit(None).cast("string"))
    done: DataFrame | None = None
    for a in range(attempts):
        last = a == attempts - 1
        tried = propose(open_.withColumn("attempt", F.lit(a)))
        gold = F.when(F.col("query_type") == "Unanswerable", vocab.NO_ANSWER).otherwise(answer_from(F.col("question"), F.col("evidence")))
        judged = kept(tried.withColumn("gold", gold).withColumn("reason", objection(last, strict)))
        reasons = F.when(F.col("reason").isNotNull(), F.concat("reasons", F.array("reason"))).otherwise(F.col("reasons"))
        judged = judged.withColumn("reasons", reasons)
        out = judged if last else judged.filter("reason is null")
        out = out.select("qid", "asked_type", "query_type", "question", "target", "gold", F.lit(a + 1).alias("attempts"), "reasons", F.col("reason").isNotNull().alias("gave_up"))
        done = out if done is None else done.unionByName(out)
        turned = F.when((F.col("reason") == "repeats") & F.col("query_type").isin(*CIRCLING) & F.lit(not forced), "Multi-Hop").otherwise(F.col("query_type"))
        open_ = judged.filter("reason is not null").withColumn("query_type", turned).select(*open_.columns)
    return done


def grounded_seeds(seeds: DataFrame, hits: DataFrame, wider: tuple[int, ...] = WIDER, least: float = ANSWERABLE) -> DataFrame:
    """``seeds`` (qid, question) with the question to use, the attempt that grounded it, and the passage that did.

    ``hits`` (qid, rank, chunk_id, text) are the passages of the widest attempt:
    an attempt looks at the first so many, so one search serves them all. A
    question is grounded by a sentence with a share of its tokens. One that no
    attempt grounds is replaced by a question about the first entity of its best
    passage; one without any passage stays as it is, ungrounded.
    """
    from turnlens.operators import graph

    each = hits.filter(F.col("rank") <= wider[-1]).join(seeds.select("qid", token_set(F.col("question")).alias("q")), "qid")
    answers = F.exists(sentences(F.col("text")), lambda s: share(F.col("q"), token_set(s)) >= least)
    first = each.withColumn("ok", answers).groupBy("qid").agg(F.min(F.when(F.col("ok"), F.struct("rank", "chunk_id"))).alias("g"), F.min_by(F.struct("chunk_id", "text"), "rank").alias("top"))
    met = seeds.join(first, "qid", "left")
    attempt = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(wider))):
        attempt = F.when(F.col("g.rank") <= k, i).otherwise(attempt)
    about = F.get(graph.entities(F.col("top.text")), F.lit(0))
    other = F.when(F.col("top").isNull(), F.col("question")).otherwise(control.template(F.lit("Topic Shift"), about, about))
    return met.select(
        "qid", F.when(F.col("g").isNotNull(), F.col("question")).otherwise(other).alias("question"), attempt.alias("attempt"),
        (F.col("g").isNull() & F.col("top").isNotNull()).alias("rewritten"), F.coalesce("g.chunk_id", "top.chunk_id").alias("chunk_id"),
    )
