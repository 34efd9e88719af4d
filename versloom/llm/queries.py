"""The pN_ queries and the SQL they are checked against, gathered from the modules of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("splits", "scans", "terms", "spans", "capping", "pieces", "packing", "leaks", "repeats")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"versloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= getattr(_module, "ORACLE_SQL", {})
