"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievery.plans import aggregates, curation, governance, joins, merges, pages, records, resolution, states, texts, validation, windows

MODULES = (aggregates, curation, governance, joins, merges, pages, records, resolution, states, texts, validation, windows)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
