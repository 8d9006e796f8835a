"""All registered queries over the driver's tables, each with an independent DuckDB text."""

from __future__ import annotations

from . import claims, incremental, metrics, more, named, relational, rules, shops, steps, text, work
from .base import Query

_CATALOGS = [relational.catalog, metrics.catalog, text.catalog, more.catalog, steps.catalog, incremental.catalog, claims.catalog, shops.catalog, rules.catalog, work.catalog, named.catalog]

QUERIES: dict[str, Query] = {name: q for c in _CATALOGS for name, q in c.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for c in _CATALOGS for name, sql in c.oracle.items()}
FLAGSHIP: Query = QUERIES["flagship_need_month"]
