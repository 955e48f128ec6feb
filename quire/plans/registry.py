"""Registered queries of the document operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _families():
    from quire.plans import account_queries, catalog_queries, driver_queries, ingest_queries, record_queries, session_queries, small_queries, text_queries, usage_queries, view_queries

    return text_queries, catalog_queries, usage_queries, record_queries, account_queries, session_queries, ingest_queries, view_queries, driver_queries, small_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in _families() for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _families() for name, sql in family.SQL.items() if sql}
