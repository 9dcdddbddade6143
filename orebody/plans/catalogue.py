"""All core queries by name."""

from __future__ import annotations

from orebody.plans import mining_queries, record_queries

_MODULES = (record_queries, mining_queries)

QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
