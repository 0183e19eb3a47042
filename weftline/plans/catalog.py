"""The registered queries with their SQL twins."""

from __future__ import annotations

from weftline.plans import fixture_queries, graph_queries, retrieval_queries, scoring_queries, service_queries, sql_surface, stream_queries, tree_queries

FLAGSHIP = "impact_reverse"
QUERIES: dict = {}
SQL: dict[str, str] = {}
for part in (fixture_queries, graph_queries, retrieval_queries, scoring_queries, service_queries, sql_surface, stream_queries, tree_queries):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
