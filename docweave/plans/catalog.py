"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from docweave.plans import answer_queries, collection_queries, ingest_queries, metrics_queries, search_queries, stream_queries, text_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (text_queries, search_queries, answer_queries, metrics_queries, collection_queries, ingest_queries, stream_queries):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
