"""Quality rules: a decision list learned from labelled statistics. [native]

Every whole text is described by statistics that Spark expressions compute in
its own row, without a shuffle. From the statistics of a bounded sample of
labelled rows, sequential covering learns rules for texts to drop: it grows a
conjunction of thresholds by information gain on one part of the sample,
prunes it on the other, removes what it covers and goes on, until a rule is no
longer sure enough. The list becomes one ordered Spark ``CASE`` expression.

Defined results: a null or empty text has no words and fails the base rules.
Repeated rows are judged alike. Rows whose label is null do not train; without
labels of both kinds the list is empty and base rules alone decide. Repeated
windows are told by 64-bit hashes. Very long texts are read whole. An empty table
gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import WORD

#: Labelled rows that training reads at most.
TRAIN_ROWS = 20_000
#: Words of a window whose repetition counts.
WINDOW = 8
#: Base rules: fewer words than this, or this percentage of words in repeated windows.
LEAST_WORDS, REPEAT_PERCENT = 20, 30
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: What a rule must reach on the rows it was not grown on, and the least it covers there.
PRECISION, LEAST_COVER = 0.9, 3
MAX_RULES, MAX_TERMS, CUTS = 12, 4, 48

#: Rates that rules may test, from the base statistics.
RATES: dict[str, Callable[[], Column]] = {
    "word_length": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbol_rate": lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "dup_line_rate": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeat_rate": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "capital_rate": lambda: F.col("n_capitals") / F.greatest("word_chars", F.lit(1)),
    "exclaim_rate": lambda: F.col("n_exclaims") / F.greatest("n_words", F.lit(1)),
    "distinct_rate": lambda: F.col("n_distinct") / F.greatest("n_words", F.lit(1)),
    "words": lambda: F.col("n_words").cast("double"),
}

Term = tuple[str, bool, float]  # rate, whether above, threshold
Rule = list[Term]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in ``window``-word windows that stand twice or more in the array."""

    def cover(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            # beyond either end there is no neighbour (null), which equals nothing
            same = lambda x, j: F.coalesce((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j)), lambda x: x["i"]))

        gaps = lambda p: F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(window)), F.lit(window)))
        total = bind(bind(ordered, starts), lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, g: a + g))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(total)

    # hashes of 1, 2, 4, 8 words: each pairs two of half the length (a window is a power of two)
    def doubled(half: Column, k: int) -> Column:
        pairs = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + k)))
        return bind(half, lambda h: pairs(h))

    hashes, k = F.transform(words, lambda w: F.xxhash64(w)), 1
    while k < window:
        hashes, k = doubled(hashes, k), 2 * k
    whole = F.slice(hashes, 1, F.size(words) - (window - 1))  # beyond these, windows are cut short
    return F.when(F.size(words) >= window, bind(whole, cover)).otherwise(0)


def statistics(docs: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the base statistics of each row; no shuffle, no Python."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    return (
        docs.select(*keep, text.alias("_t"))
        .withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
        .select(
            *keep,
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            without(SYMBOLS).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
            bind(F.col("_words"), lambda w: repeated_words(w)).cast("long").alias("n_repeat_words"),
            F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
            without("!").cast("long").alias("n_exclaims"),
            F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        )
        .withColumn("n_dup_lines", F.col("_lines.dup").cast("long")).withColumn("n_lines", F.col("_lines.n").cast("long")).drop("_lines")
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(lambda a, t: a & ((x[t[0]] > t[2]) if t[1] else (x[t[0]] <= t[2])), rule, np.ones(len(next(iter(x.values()))), bool))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    """Add the threshold of the greatest FOIL gain until only texts to drop are covered."""
    rule: Rule = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_TERMS:
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        if not p0 or not n0:
            break
        best: tuple[float, Term | None] = (1e-9, None)
        for name, at in cuts.items():
            v = x[name][inside]
            side = np.searchsorted(at, v, side="left")  # values above at[k] have side > k
            hit = bad[inside]
            p_low, n_low = (np.bincount(side[m], minlength=len(at) + 1).cumsum()[:-1] for m in (hit, ~hit))
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), 0.0)
                k = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (float(gain[k]), (name, above, float(at[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _covers([best[1]], x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """An ordered list of rules for rows to drop."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    if not len(bad) or not bad.any() or bad.all():
        return rules
    part = np.arange(len(bad)) % 3 == 2  # rows come in hashed order: a random third prunes
    cuts = {name: np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1], method="inverted_cdf")) for name, v in x.items()}
    for name, v in x.items():  # finer among the rows to drop, which may be few
        cuts[name] = np.unique(np.r_[cuts[name], np.quantile(v[bad], np.linspace(0, 1, CUTS + 2)[1:-1], method="inverted_cdf"), v.min()])
    while len(rules) < MAX_RULES:
        grow, prune = left & ~part, left & part
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], cuts)
        if not rule:
            break
        worth = []
        for n in range(1, len(rule) + 1):
            c = _covers(rule[:n], x) & prune
            p, q = (c & bad).sum(), (c & ~bad).sum()
            worth.append(((p - q) / max(p + q, 1), p + q, n))
        best = max(worth, key=lambda w: (w[0], -w[2]))
        rule = rule[: best[2]]
        c = _covers(rule, x) & left
        seen = c & prune
        if seen.sum() < LEAST_COVER or (seen & bad).sum() < PRECISION * seen.sum() or (c & bad).sum() < PRECISION * c.sum():
            break
        rules.append(rule)
        left &= ~c
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The list as one ordered conditional expression: true to keep."""
    out: Column | None = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, [(F.col(f"_{n}") > c) if above else (F.col(f"_{n}") <= c) for n, above, c in rule])
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def with_rates(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"_{n}": f() for n, f in RATES.items()})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled rows, chosen by a hash of their ids."""
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
        .withColumn("_order", F.xxhash64(F.lit(2), F.col("_id"))).orderBy("_order", "_id").limit(rows)
    )
    # of rows that share a labelled id the least text is learned from
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    sample = texts.join(F.broadcast(known), "_id").groupBy("_order", "_quality").agg(F.min("_text").alias("text"))
    got = with_rates(statistics(sample, ["_order", "_quality"])).filter(~base_failed()).select("_order", "_quality", *(f"_{n}" for n in RATES)).collect()
    got.sort(key=lambda r: r["_order"])
    x = {n: np.array([r[f"_{n}"] for r in got], float) for n in RATES}
    return learn(x, np.array([r["_quality"] == 0 for r in got], bool))


def judge(docs: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, the statistics, base_failed and kept of each row."""
    rated = with_rates(statistics(docs, keep)).withColumn("base_failed", base_failed())
    return rated.withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop(*(f"_{n}" for n in RATES))
