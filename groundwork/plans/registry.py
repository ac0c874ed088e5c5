"""Named queries of the core and the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("retrieval", "measurement", "books", "judging", "state", "models", "records")
FLAGSHIP = "hybrid_topk"

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _m = import_module(f"groundwork.plans.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
