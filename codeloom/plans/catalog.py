"""All named queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

import importlib

from codeloom.plans import registry

MODULES = ("relational", "graph", "quality", "history", "search", "resolution", "federation", "documents", "sources", "store", "stream", "composite", "contracts")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"codeloom.plans.{m}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLE)
