"""Columns that SQL can express, clashing names, shared ids and texts that are slow to scan carelessly."""

from __future__ import annotations

import inspect
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import cases
from turnlens.llm import common, entry, exact_dedup, mixing, ngram_join, quality_rules, toxicity, url_filter

SF = f"{DATA}/sf0.001"
WORD = r"[^\\x20\\x09-\\x0D]+".replace("\\\\", "\\")

BASE = f"""
    SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols
    FROM (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents)
"""
MIX = f"""
    WITH RECURSIVE sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
    per AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
    -- a round settles the sources above three times their size, until none is
    share(i, source, source_size, weight, target, settled) AS (
        SELECT 0, source, source_size, weight, sum(source_size) OVER () * weight / sum(weight) OVER (), false FROM per
        UNION ALL
        SELECT i + 1, source, source_size, weight,
               CASE WHEN settled OR target > 3 * source_size THEN 3.0 * source_size
                    ELSE (sum(source_size) OVER () - sum(CASE WHEN settled OR target > 3 * source_size THEN 3.0 * source_size ELSE 0 END) OVER ()) * weight
                         / sum(CASE WHEN settled OR target > 3 * source_size THEN 0 ELSE weight END) OVER () END,
               settled OR target > 3 * source_size
        FROM share WHERE i < (SELECT count(*) FROM per))
    SELECT doc_id, size, source_size::BIGINT AS source_size, target
    FROM sized JOIN (SELECT * FROM share WHERE i = (SELECT count(*) FROM per)) s ON sized.source IS NOT DISTINCT FROM s.source
"""
URL = """
    SELECT page_id, host, path, CASE WHEN h('example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7' WHEN h('example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
           WHEN h('com') AND starts_with(path, '/en/') THEN 'com/en/' WHEN h('net') AND starts_with(path, '/de/') THEN 'net/de/' WHEN h('org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
    FROM (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
          FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages))
"""


@pytest.mark.parametrize(("query", "sql"), [("op1_quality_rules", BASE), ("op4_mix_sources", MIX), ("op8_url_filter", URL)])
def test_columns_that_sql_expresses(spark, query, sql):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = re.sub(r"h\('([a-z.]+)'\)", r"(host = '\1' OR ends_with(host, '.\1'))", sql)
    want = db.execute(sql).df()
    got = entry.QUERIES[query](spark, SF).select(*want.columns).toPandas()
    key = want.columns[0]
    for c in want.columns[1:]:
        a, b = (d.sort_values(key)[c].tolist() for d in (got, want))
        same = [x == y or (x is None and y is None) or (isinstance(x, float) and abs(x - y) < 1e-6 * max(1, abs(y))) or (x != x and y != y) for x, y in zip(a, b, strict=True)]
        assert all(same), c


def clashing(spark):
    return cases.documents(spark).withColumns({c: F.lit(7) for c in ("order", "y", "_id", "_t", "_order", "n_words", "base_failed", "host")})


def test_column_names_do_not_clash(spark):
    docs = clashing(spark)
    labels = spark.createDataFrame([(4, 1, 1), (6, 0, 0), (8, 0, 1), (11, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.clean(docs, labels).columns == docs.columns
    assert quality_rules.judge(docs, quality_rules.train(docs, labels)).count() == docs.count()
    assert mixing.mixed(docs).columns == docs.columns


def internal_names() -> list[str]:
    """Every name that the stages' modules give a column."""
    found = set()
    for m in (common, exact_dedup, mixing, ngram_join, toxicity):
        found |= set(re.findall(r"""["'](_[a-z]\w*)["']""", inspect.getsource(m)))
    return sorted(found)


def test_stages_leave_every_name_to_the_caller(spark):
    names = internal_names()
    assert {"_gh", "_key", "_gid", "_one", "_maybe", "_reg", "_size", "_pattern", "_times", "_full", "_score", "_text"} <= set(names)
    docs = cases.documents(spark).withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in [*names, "caller0"]})
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 0, 0), (7, 0, 0), (8, 0, 0), (9, 1, 0), (11, 1, 0), (14, 1, 1)], "doc_id long, quality int, toxic int")
    for stage in (lambda d: toxicity.clean(d, labels), exact_dedup.drop_copies, ngram_join.keep_one, mixing.mixed):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)


def test_mix_tells_rows_of_one_id_apart(spark):
    """Seven rows without an id, ids given twice with different texts, and a row given twice: one row out for each."""
    word = lambda n, k: " ".join(f"w{k}" for _ in range(n))
    rows = [(None, word(10 + k, k), "en", "a") for k in range(7)] + [(k // 2, word(20 + k, k), "en", "a") for k in range(16)]
    rows += [(50, word(30, 1), "en", "a")] * 2 + [(100 + k, word(25, k), "en", "b") for k in range(60)]
    got = mixing.taken(cases.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 30 and all(r["taken"] <= 3 * r["size"] for r in mine)


def test_marked_words():
    assert list(toxicity.marked_words("an id1ot, a.b.c x-- y9 --z st.u-p")) == ["id1ot", "a.b.c", "st.u-p"]
    for text in ("a" * 1_000_000, "a." * 500_000, "a" * 500_000 + "1" * 500_000, "A" * 1_000_000):
        start = time.perf_counter()
        toxicity.featurize(text, toxicity.Weights({}))
        assert time.perf_counter() - start < 3


def test_url_table_has_no_host_of_pages(spark):
    hosts = {r[0].removeprefix("www.") for r in url_filter.judge(spark.read.parquet(f"{DATA}/sf0.1/pages.parquet")).select("host").distinct().collect()}
    table = {url_filter.host_and_path(u)[0].removeprefix("www.") for u, _ in url_filter.labelled_urls()}
    assert not hosts & table
    model = url_filter.train()
    names = [*url_filter.invented(400, seed=77), "bbc", "github", "nytimes", "lemonde", "spiegel", "elpais", "wikipedia", "acme"]
    assert sum(model.score(f"{n}.org", "/a/1") >= 0.6 for n in names) <= 0.02 * len(names)
    assert all(model.score(h, "/") >= 0.6 for h in ("best-casino-slots.net", "freebetting.info", "xxxporn.biz"))
