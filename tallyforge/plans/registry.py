"""Queries of the invoice operators and the SQL that says the same, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("worklist", "scalars", "derive", "matching", "pricing", "review", "approval", "ladder", "shown", "export", "profiles", "documents", "intake")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        import_module(f"tallyforge.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
