"""Every query by name, and its SQL."""

from __future__ import annotations

from turnlens.plans import attempt_queries, attribution_queries, control_queries, dialogue_queries, evidence_queries, graph_queries, judge_queries, quality_queries, replay_queries, retrieval_queries, source_queries, stats_queries, text_queries, tree_queries, window_queries

_MODULES = (text_queries, window_queries, stats_queries, attribution_queries, quality_queries, retrieval_queries, graph_queries, control_queries, replay_queries, source_queries, tree_queries, evidence_queries, dialogue_queries, attempt_queries, judge_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
