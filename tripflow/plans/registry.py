"""Registry of the queries the driver runs, each with the SQL that states the same result."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is left out where SQL cannot say it."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def load_all() -> None:
    from tripflow.plans import catalog
    for mod in sorted(m.name for m in pkgutil.iter_modules(catalog.__path__)):
        importlib.import_module(f"tripflow.plans.catalog.{mod}")
