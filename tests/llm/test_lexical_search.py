"""Ranked search against SQL, and against scores of every document one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tests.llm.cases import documents, empty
from tests.oracle import differences
from turnlens.llm import lexical_search
from turnlens.llm.entry import op13_ranked_search


def brute(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    lower = str.maketrans(lexical_search.UPPER, lexical_search.LOWER)
    terms = lambda text: re.findall(lexical_search.TERM, (text or "").translate(lower))
    rows = [(d, Counter(t)) for d, text in docs if (t := terms(text))]
    total = sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in rows:
            m = 100 - 90 + (90 * c.total() * len(rows)) // total
            s = sum(math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d if d is not None else 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def key(r: tuple) -> tuple:
    return tuple((x is None, x or 0) for x in r)


WORDS = ["the", "The", "a", "of", "river", "Über", "über", "x1", "漢字", "stone", "bridge", "old", "ab-cd", "rare", "it's"]


def rows_of(rng: random.Random, n: int) -> list[tuple]:
    weights = [2 ** -(i / 2) for i in range(len(WORDS))]
    return [(rng.choice([i, i, i, i // 2]), rng.choice([None, "", "...", *[" ".join(rng.choices(WORDS, weights, k=rng.randint(1, 40)))] * 20])) for i in range(n)]


@pytest.mark.parametrize(("shard", "k"), [(1 << 20, 10), (40, 10), (200, 3), (1, 1)])
def test_against_brute_force(spark, monkeypatch, shard, k):
    rng = random.Random(shard + k)
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", shard)
    docs = [*rows_of(rng, 500), (None, "rare stone bridge"), (None, "river river"), (3, "rare rare rare")]
    items = [(i, rng.choice(["", None, "zzz", *[" ".join(rng.choices(WORDS, k=rng.randint(1, 12)))] * 12])) for i in range(60)]
    frame = documents(spark, [(d, t, "en", "a") for d, t in docs]).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score", "3 AS rank", "4 AS query", "5 AS part")
    got = [tuple(r) for r in lexical_search.search(frame, asked, k).collect()]
    assert sorted(got, key=key) == sorted(brute(docs, items, k), key=key)


def test_queries_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    docs, items = rows_of(rng, 100), [(i, " ".join(rng.choices(WORDS, k=5))) for i in range(20)]
    monkeypatch.setattr(lexical_search, "BLOCK_QUERIES", 7)
    got = lexical_search.search(documents(spark, [(d, t, "en", "a") for d, t in docs]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_documents_are_skipped():
    """The heap's least score keeps most of a frequent term's documents from being looked at."""
    n = 20_000
    looked = []

    class Seen(list):
        def __getitem__(self, i):
            looked.append(i)
            return list.__getitem__(self, i)

    frequent = (list(range(n)), Seen([1] * n), 1)
    rare = (list(range(0, n, 1000)), [100 + i for i in range(n // 1000)], 119)
    heap: list = []
    lexical_search.wand([frequent, rare], heap, 3, range(n))
    assert sorted(heap) == [(118, -17_000), (119, -18_000), (120, -19_000)]
    assert len(looked) < n // 9  # all until three rare ones have been seen, then those alone


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    none = empty(spark)
    assert lexical_search.search(none, items).collect() == []
    found = lexical_search.search(documents(spark), items.limit(0))
    assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_query_against_sql(spark, tmp_path):
    more, less, n = differences(spark, tmp_path, "/root/testdata/sf0.001", op13_ranked_search, lexical_search.SQL)
    assert not more and not less and n == 400
