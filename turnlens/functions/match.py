"""Predicates that grade answers and contexts, without a language model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlens.functions import vocab
from turnlens.functions.text import contains_any, share, token_set


def _prefix_match(gold: Column, answer: Column) -> Column:
    """Whether the first 30 characters of either stand in the other (both lower-cased)."""
    return answer.contains(F.substring(gold, 1, 30)) | gold.contains(F.substring(answer, 1, 30))


def grade(gold: Column, answer: Column, unanswerable: Column) -> Column:
    """The turn grader: correct, wrong, hallucinated or abstained. An empty gold grades correct."""
    low, g = F.lower(F.coalesce(answer, F.lit(""))), F.lower(F.coalesce(gold, F.lit("")))
    return (
        F.when(F.trim(low) == "", "abstained")
        .when(contains_any(low, vocab.GRADER_ABSTENTIONS), "abstained")
        .when(unanswerable, "hallucinated")
        .when(_prefix_match(g, low), "correct")
        .otherwise("wrong")
    )


def lexical_correct(gold: Column, answer: Column) -> Column:
    """The study's check: a prefix of either in the other, or 0.6 of the gold tokens; never for empty texts."""
    g, a = F.trim(F.lower(F.coalesce(gold, F.lit("")))), F.lower(F.coalesce(answer, F.lit("")))
    return F.when((g == "") | (a == ""), False).otherwise(_prefix_match(g, a) | (share(token_set(g), token_set(a)) >= 0.6))


def abstained(answer: Column) -> Column:
    return contains_any(answer, vocab.STUDY_ABSTENTIONS)


def did_fail(gold: Column, answer: Column, unanswerable: Column) -> Column:
    return F.when(unanswerable, ~abstained(answer)).otherwise(~lexical_correct(gold, answer))


def contains_answer(passage: Column, answer: Column) -> Column:
    p, a = F.lower(F.coalesce(passage, F.lit(""))), F.trim(F.lower(F.coalesce(answer, F.lit(""))))
    return F.when(a == "", False).otherwise(p.contains(a) | (share(token_set(a), token_set(p)) >= 0.6))


def gold_in_context(gold: Column, contexts: Column) -> Column:
    """Whether one of the contexts has half of the gold tokens."""
    g = token_set(gold)
    return F.coalesce(F.exists(F.coalesce(contexts, F.array()), lambda c: share(g, token_set(c)) >= 0.5), F.lit(False)) & (F.size(g) > 0)
