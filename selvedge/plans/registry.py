"""Names of the queries, each with its Spark form and, where SQL can say it, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) function under a name."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def load() -> None:
    """Import the modules whose queries register themselves."""
    for name in ("rolls", "resolution", "papers", "books", "feedback", "service"):
        import_module(f"{__package__}.{name}")
