"""All core queries and their SQL, by name."""

from __future__ import annotations

from skeinery.plans import orphan_queries, reference_queries

MODULES = [reference_queries, orphan_queries]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
