"""Queries by name, and the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) function under a name, with its SQL if there is any."""

    def register(make):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = make
        if sql is not None:
            ORACLES[name] = sql
        return make

    return register
