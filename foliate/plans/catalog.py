"""The registry of named queries: each has a Spark form and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliate.plans import fact_queries, join_queries, search_queries, stream_queries, text_queries, view_queries

Query = Callable[[SparkSession, str], DataFrame]
AREAS = (search_queries, text_queries, fact_queries, view_queries, stream_queries, join_queries)


def queries() -> dict[str, Query]:
    return {name: f for area in AREAS for name, f in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for area in AREAS for name, text in area.ORACLES.items()}
