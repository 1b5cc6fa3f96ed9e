"""Queries over the driver's tables and the SQL each must agree with."""

from __future__ import annotations

from fewstep.plans import catalog, service  # noqa: F401  service adds its queries

QUERIES = catalog.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL
