"""All queries of the library, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwell.plans import chunkers, drift, events, knowledge, operations, research, retrieval, searching  # noqa: F401  (they register their queries)
from tarnwell.plans.registry import QUERIES, SQL

FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
