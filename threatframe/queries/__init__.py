"""Registered queries: each applies an operator to the driver's tables, with DuckDB SQL of the same meaning."""

from __future__ import annotations

from threatframe.sources.security import with_sec

FOUND: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, sec: bool = True):
    """Register a query; sql may use the `sec` view unless sec is False."""

    def register(f):
        FOUND[name] = f
        if sql:
            SQL[name] = with_sec(sql) if sec else sql
        return f

    return register
