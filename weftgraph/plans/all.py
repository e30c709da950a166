"""All registries of the core."""

from __future__ import annotations

from . import build, graph, records
from .registry import Query

MODULES = [graph, records, build]


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.R.sql.items()}
