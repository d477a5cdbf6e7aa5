"""Column functions on small and odd inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from turnlens.functions import guards, match, slots, stats
from turnlens.functions import text as t


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "want"), [("Iechä CO2!", ["iech", "co2"]), ("", []), (None, [])])
def test_tokens(spark, text, want):
    assert one(spark, t.tokens(F.col("s")), s=F.lit(text).cast("string")) == want


@pytest.mark.parametrize(("name", "want"), [("The Alder (1931)", "the_alder_1931"), ("é!", "entity"), ("__a__", "a")])
def test_slug(spark, name, want):
    assert one(spark, t.slug(F.col("s")), s=name) == want


@pytest.mark.parametrize(("k", "n"), [(0, 0), (0, 5), (5, 5), (3, 10)])
def test_wilson(spark, k, n):
    low, high = (one(spark, c, k=k, n=n) for c in stats.wilson(F.col("k"), F.col("n")))
    if n == 0:
        assert (low, high) == (0.0, 0.0)
        return
    z, p = 1.96, k / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    assert low == pytest.approx(max(0.0, centre - half)) and high == pytest.approx(min(1.0, centre + half))
    assert 0 <= low <= high <= 1


@pytest.mark.parametrize("counts", [(3, 10, 3, 10), (0, 0, 1, 2), (5, 5, 7, 7), (9, 10, 2, 11)])
def test_two_proportions(spark, counts):
    k1, n1, k2, n2 = counts
    z, p = (one(spark, c, a=k1, b=n1, c=k2, d=n2) for c in stats.two_proportion_z(*(F.col(x) for x in "abcd")))
    pooled = (k1 + k2) / (n1 + n2)
    if not n1 or not n2 or pooled in (0, 1):
        assert (z, p) == (0.0, 1.0)
    else:
        want = (k1 / n1 - k2 / n2) / math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
        assert z == pytest.approx(want) and p == pytest.approx(math.erfc(abs(want) / math.sqrt(2)), abs=1e-6)


@pytest.mark.parametrize(("b", "c", "chi"), [(0, 0, 0.0), (3, 3, 1 / 6), (10, 2, 49 / 12)])
def test_mcnemar(spark, b, c, chi):
    got, p = (one(spark, x, b=b, c=c) for x in stats.mcnemar(F.col("b"), F.col("c")))
    assert got == pytest.approx(chi) and 0 <= p <= 1


@pytest.mark.parametrize(
    ("gold", "answer", "unanswerable", "want"),
    [("x", "", False, "abstained"), ("x", "I don't know.", False, "abstained"), ("x", "it is y", True, "hallucinated"), ("", "anything", False, "correct"), ("Paris", "paris, france", False, "correct"), ("Paris", "Rome", False, "wrong")],
)
def test_grade(spark, gold, answer, unanswerable, want):
    assert one(spark, match.grade(F.col("g"), F.col("a"), F.col("u")), g=gold, a=answer, u=unanswerable) == want


def test_lexical_correct_guards_empty_gold(spark):
    assert one(spark, match.lexical_correct(F.col("g"), F.col("a")), g="", a="x") is False
    assert one(spark, match.lexical_correct(F.col("g"), F.col("a")), g="one two three four five", a="five four three, no") is True


def test_guards(spark):
    assert one(spark, guards.latex_label(F.col("s")), s="see TABREF1 there")
    assert one(spark, guards.citation_only(F.col("s")), s="was introduced in [7]")
    assert not one(spark, guards.citation_only(F.col("s")), s="They can use SMOTE [9]")
    assert one(spark, guards.restates(F.col("q"), F.col("g")), q="what do secondary users aim to optimise", g="secondary users aim to optimise secondary users")
    assert one(spark, guards.has_pronoun(F.col("s")), s="What did it do?") and not one(spark, guards.has_pronoun(F.col("s")), s="What did item do?")


def test_slots(spark):
    answer = "Model A costs two coins. Model B is accurate."
    assert one(spark, slots.covered(F.col("s"), F.col("a")), s="Model A :: costs coins", a=answer)
    assert not one(spark, slots.covered(F.col("s"), F.col("a")), s="Model B :: costs coins", a=answer)


def test_presence_is_three_valued(spark):
    ctx = F.array(F.lit("the bridge opened"))
    assert one(spark, slots.present(F.lit("bridge opened"), ctx)) is True
    assert one(spark, slots.present(F.lit("mill river"), ctx)) is False
    assert one(spark, slots.present(F.lit("the of"), ctx)) is None
