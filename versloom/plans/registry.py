"""Queries and the SQL each is checked against, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, ints: tuple[str, ...] = ()) -> Callable:
    """Registers a function of a session and a folder under its name, with DuckDB SQL if the operator can be put so.

    ``ints`` names columns that are 32 bits wide here and 64 bits there.
    """

    def register(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql if not ints else f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in ints)}) FROM ({sql})"
        return f

    return register


def sql_list(words: list[str]) -> str:
    """``words`` as a SQL list."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
