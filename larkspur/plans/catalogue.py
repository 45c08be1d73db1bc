"""Queries for the retrieval engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans import relational, search, streams, texts

ALL = (search.plans, texts.plans, relational.plans, streams.plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for plans in ALL for name, query in plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plans in ALL for name, sql in plans.sql.items()}
