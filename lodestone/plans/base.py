"""Registering queries: a name, a function of (spark, folder), and DuckDB SQL for the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if oracle:
            ORACLE[name] = oracle
        return function

    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def like(column: str, pattern: str) -> str:
    """DuckDB SQL for whether a pattern matches anywhere."""
    return f"regexp_matches({column}, {quoted(pattern)})"
