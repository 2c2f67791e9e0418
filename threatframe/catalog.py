"""All registered queries of the security-log operators, by survey id, with DuckDB SQL of the same meaning."""

from __future__ import annotations

from threatframe import queries as registry
from threatframe.queries import cases, compliance, detection, files, folders, ingest, overview, reports, sinks, streams, text  # noqa: F401  (they register their queries)


def queries() -> dict:
    return dict(registry.FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
