"""Edge support over chunks with more entities than the extraction lists."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from turnlens.plans import catalog

#: Twenty names that stand far apart, in two documents; the first chunk that mentions the last two.
NAMES = [f"{a}{b}ville" for a in ("Al", "Be", "Ca", "Do") for b in ("ra", "mi", "to", "ne", "su")]


@pytest.fixture()
def folder(spark, tmp_path):
    text = ", then ".join(NAMES) + " and so on to the end of this long paragraph."
    short = f"{NAMES[18]}, after which comes nothing but lower case until, at the very end, there is {NAMES[19]}."
    spark.createDataFrame([(1, text), (2, short), (3, text)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_entities_beyond_the_twelfth_have_support(spark, folder):
    got = {(r.source, r.target): (r.n, r.first) for r in catalog.QUERIES["edge_support"](spark, folder).collect()}
    low = [n.lower() for n in NAMES]
    assert set(got) == set(zip(low, low[1:]))
    assert got[low[18], low[19]] == (3, 1 << 20) and got[low[17], low[18]] == (2, 1 << 20)


def test_sql_counts_the_same(spark, folder):
    got = sorted(map(tuple, catalog.QUERIES["edge_support"](spark, folder).select("source", "target", "n", F.col("first")).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT source, target, n, first FROM ({catalog.SQL['edge_support']})").fetchall())
