"""All queries of the engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import claim_queries, gate_queries, graph_queries, numeric_queries, report_queries, retrieval_queries, text_queries

PARTS = (text_queries, gate_queries, claim_queries, numeric_queries, retrieval_queries, graph_queries, numeric_queries, report_queries)
FLAGSHIP = "flagship_conflicts"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in PARTS:
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
