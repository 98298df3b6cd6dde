"""Queries by name, each with the tables it reads and, where SQL can say it, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeworks.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of the named tables; one of no tables gets the session."""

    def enter(operator):
        QUERIES[name] = lambda spark, folder: operator(*(table(spark, folder, t) for t in tables)) if tables else operator(spark)
        if sql:
            ORACLES[name] = sql
        return operator

    return enter
