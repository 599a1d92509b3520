"""The register that catalogue modules enter their queries in."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable:
    """Enters a query under the name of its function, with the SQL that gives the same rows where there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
