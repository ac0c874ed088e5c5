"""Queries and SQL of this subpackage, module by module."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ocr", "topn", "consensus", "pieces", "neighbours", "near_duplicates", "pairs", "tokens", "leakage", "sentences")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _m = import_module(f"groundwork.llm.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
