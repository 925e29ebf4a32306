"""All queries over the reference's operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("scalar_queries", "relational_queries", "search_queries", "ingest_queries", "catalog_queries")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"quarry.plans.{_name}")
    if twice := QUERIES.keys() & _module.QUERIES.keys():
        raise ValueError(f"registered twice: {sorted(twice)}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
