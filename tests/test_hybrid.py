"""Candidates of hybrid search found among the best passages, and scored alone where they are rare there."""

from __future__ import annotations

import pytest

from tests.conftest import DATA
from tests.oracle import differences
from turnlens.plans import catalog, graph_queries


@pytest.mark.parametrize("deep", [5, 200])
def test_hybrid_agrees_with_sql_however_deep_it_looks(spark, tmp_path, monkeypatch, deep):
    scored = []
    made = graph_queries.v.postings
    monkeypatch.setattr(graph_queries.v, "postings", lambda units, *a: scored.append(units) or made(units, *a))
    monkeypatch.setattr(graph_queries, "DEEP", deep)
    more, less, n = differences(spark, tmp_path, f"{DATA}/sf0.01", catalog.QUERIES["hybrid_retrieve"], catalog.SQL["hybrid_retrieve"])
    assert n and not more and not less, (more[:2], less[:2])
    # postings are formed of the candidates of questions that the best passages leave open, not of all passages
    assert sum(units.count() for units in scored) < graph_queries.v.chunks(spark, f"{DATA}/sf0.01").count()
