"""Registered queries: each operator on the given tables, beside SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from tripleloom.plans import catalog_queries, channel_queries, mapping_queries

    return {**mapping_queries.QUERIES, **channel_queries.QUERIES, **catalog_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
