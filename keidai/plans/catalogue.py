"""All registered queries over the reference's operators; each reads the given tables."""

from __future__ import annotations

from keidai.plans import network_queries, page_queries, table_queries, text_queries

MODULES = (table_queries, text_queries, network_queries, page_queries)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.SQL.items()}
