"""Registered queries over the test tables, each with its SQL counterpart where SQL can state it."""

from voltlattice.catalog.registry import QUERIES, SQL
from voltlattice.catalog import aggregates, documents, features, functions, joins, quality, tables  # noqa: F401
from voltlattice.catalog import forecasts  # noqa: F401  last: its queries fit models

__all__ = ["QUERIES", "SQL"]
