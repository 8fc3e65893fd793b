"""Names of the library's own queries, with their DuckDB twins."""

from __future__ import annotations

from . import catalog, library


def queries() -> dict:
    return catalog.queries() | library.queries()


def oracle_sql() -> dict[str, str]:
    return catalog.oracle_sql() | library.oracle_sql()
