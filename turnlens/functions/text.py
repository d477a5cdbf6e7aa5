"""Text columns: tokens, sentences, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where the optimizer would else write it out in each place, or for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def tokens_without(text: Column, stop: Sequence[str], longer_than: int = 0) -> Column:
    """Distinct tokens that are no stop words and have more characters than given."""
    return F.filter(token_set(text), lambda t: ~t.isin(*stop) & (F.length(t) > longer_than))


def space_tokens(text: Column) -> Column:
    """Lower-cased runs without white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` before white space."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\n\f\r]+", "$1␞"), "␞")


def slug(name: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(made == "", "entity").otherwise(made)


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def share(part: Column, whole: Column) -> Column:
    """|part & whole| / |part| of two token arrays; 0 for an empty part."""
    return F.when(F.size(part) == 0, 0.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
