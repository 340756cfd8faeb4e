"""Queries over the driver's tables, and SQL that checks them."""

from __future__ import annotations

from tessera.plans import answering, catalogs, search, texts

QUERIES = search.QUERIES | texts.QUERIES | catalogs.QUERIES | answering.QUERIES
SQL = search.SQL | texts.SQL | catalogs.SQL | answering.SQL
