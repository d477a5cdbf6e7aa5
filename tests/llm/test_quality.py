"""Quality rules, toxicity and URL verdicts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import cases
from turnlens.llm import quality_rules, toxicity, url_filter
from turnlens.llm.common import WORD


def statistics(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    marked = {i for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for i in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


@pytest.mark.parametrize("make", [cases.documents, cases.empty, lambda s: s.read.parquet(f"{DATA}/sf0.001/documents.parquet")])
def test_base_statistics(spark, make):
    docs = make(spark).select("doc_id", "text")
    rows = quality_rules.judge(docs, [], ["doc_id", "text"]).collect()
    for r in rows:
        want = statistics(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)
    assert len(rows) == docs.count()


def test_rules_learn_thresholds_and_hold_out():
    rng = np.random.default_rng(1)
    n = 3000
    x = {k: rng.random(n) for k in quality_rules.RATES}
    bad = (x["symbol_rate"] > 0.8) | ((x["capital_rate"] > 0.7) & (x["exclaim_rate"] > 0.6))
    rules = quality_rules.learn({k: v[:2000] for k, v in x.items()}, bad[:2000])
    out = np.zeros(1000, bool)
    for rule in rules:
        out |= quality_rules._covers(rule, {k: v[2000:] for k, v in x.items()})
    assert (out == bad[2000:]).mean() > 0.95 and len(rules) >= 2
    assert quality_rules.learn(x, np.zeros(n, bool)) == [] and quality_rules.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []


def test_rules_hold_on_unseen_labels(spark):
    sf = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = F.col("doc_id") % 2 == 0
    kept = quality_rules.judge(docs, quality_rules.train(docs, labels.filter(seen))).join(labels.filter(~seen), "doc_id").filter("not base_failed")
    ok, n = kept.agg(F.avg(F.expr("cast(kept = (quality = 1) as double)")), F.count("*")).first()
    assert n > 100 and ok > 0.93


def test_no_python_in_the_plan(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    plan = quality_rules.judge(docs, quality_rules.train(docs, labels))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def toxic_score(spark, docs, labels):
    rows = toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"], "score")
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score")


def test_toxicity_holds_out(spark):
    sf = f"{DATA}/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxic_score(spark, docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.95
    # labels that are held out, and columns but the text, change nothing
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxic_score(spark, docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), other)
    a, b = (d.orderBy("doc_id").toPandas().score.to_numpy() for d in (toxic_score(spark, docs, labels), again))
    assert np.array_equal(a, b)


def test_toxicity_takes_odd_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (None, 1, 1), (7, 1, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxic_score(spark, docs, labels).collect()
    assert len(rows) == len(cases.ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxic_score(spark, cases.empty(spark), labels.limit(0)).count() == 0
    left = toxicity.clean(docs, labels.limit(0))
    assert left.columns == docs.columns and left.count() == len(cases.ROWS)


def test_isotonic_rises():
    rng = np.random.default_rng(2)
    s = rng.random(500)
    at, share = toxicity.isotonic(s, (rng.random(500) < s).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all() and 0 <= share[0] and share[-1] <= 1


URLS = [
    None, "", "no scheme/en/", "http://", "HTTP://COM/en/x", "http://a.com/en/", "http://acom/en/", "http://example.com/en/71", "http://www.EXAMPLE.com/en/7?x#y", "https://b.net/de/1", "https://example.net/de/8",
    "https://x.example.net/de/81#z", "ftp://c.org/es", "ftp://c.org/es/", "http://d.org?/es/", "http://e.com#/en/", "http://user@f.com:80/en/", "http://é.com/en/ü", "http://www.cheap-pills.example.org/fr/1", "https://museum.example.org/fr/1", "http://g.com/en/\nnext",
]


def brute_url(url):
    host, path = url_filter.host_and_path(url)
    best = ""
    for rule, _ in url_filter.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and len(rule) > len(best):
            best = rule
    return host, path, best or None


def test_url_rules(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge(rows).collect()}
    verdicts = dict(url_filter.RULES)
    for i, u in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == brute_url(u), u
        if got[i]["rule"]:
            assert got[i]["verdict"] == verdicts[got[i]["rule"]] and got[i]["score"] is None
    assert got[0]["verdict"] == "allow" and got[18]["verdict"] == "block" and got[19]["verdict"] == "allow"
    assert url_filter.judge(rows.limit(0)).count() == 0


def test_url_model_holds_out():
    rows = url_filter.labelled_urls()
    model = url_filter.train([r for i, r in enumerate(rows) if i % 4])
    unseen = [r for i, r in enumerate(rows) if i % 4 == 0]
    assert np.mean([(model.score(*url_filter.host_and_path(u)) >= 0.5) == y for u, y in unseen]) > 0.9


def test_url_verdicts_of_the_contract(spark):
    """Each rule's word as the contract lists it, on urls that one rule decides."""
    words = {"http://a.com/en/1": "block", "http://b.example.com/en/71": "allow", "http://c.net/de/1": "allow", "http://example.net/de/8": "block", "http://d.org/es/x": "block"}
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(words)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(rows).collect()}
    assert [got[i]["verdict"] for i in range(len(words))] == list(words.values())
    assert all(got[i]["score"] is None for i in got)
