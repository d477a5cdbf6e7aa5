"""Slots of decomposable questions held against answers, and the retrieval check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlens.functions import vocab
from turnlens.functions.text import share, tokens_without


def covered(slot: Column, answer: Column) -> Column:
    """Whether one sentence of the answer covers the slot.

    ``ENTITY :: dimension`` needs every entity token and half of the
    dimension's; a plain slot needs 0.6 of its tokens.
    """
    words = lambda c: tokens_without(c, vocab.STOP_WORDS)
    said = F.filter(F.split(F.coalesce(answer, F.lit("")), r"[.!?\n;]+"), lambda s: F.trim(s) != "")
    entity, dimension = F.substring_index(slot, "::", 1), F.expr("''")
    dimension = F.regexp_replace(slot, r"(?s)^.*?::", "")
    e, d, p = words(entity), words(dimension), words(slot)
    structured = (F.size(e) > 0) & F.exists(said, lambda s: (share(e, words(s)) >= 1.0) & ((F.size(d) == 0) | (share(d, words(s)) >= 0.5)))
    plain = (F.size(p) > 0) & F.exists(said, lambda s: share(p, words(s)) >= 0.6)
    return F.when(slot.contains("::"), structured).otherwise(plain)


def present(gold: Column, contexts: Column) -> Column:
    """Whether a context has half of the gold's words; null where there is nothing to check."""
    words = lambda c: tokens_without(c, vocab.STOP_WORDS, 1)
    g = words(gold)
    checkable = (F.size(g) > 0) & contexts.isNotNull() & (F.size(contexts) > 0)
    return F.when(checkable, F.exists(contexts, lambda c: share(g, words(c)) >= 0.5))
