"""All registered queries of the library with their SQL."""

from __future__ import annotations

from . import flow_queries, identity_queries, long_window_queries, ranking_queries, report_queries, rule_queries, scalar_queries, scan_queries, source_queries, stream_queries

_PARTS = (flow_queries, identity_queries, long_window_queries, ranking_queries, report_queries, rule_queries, scalar_queries, scan_queries, source_queries, stream_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
FLAGSHIP = flow_queries.flagship
