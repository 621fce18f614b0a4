"""The library's registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark import registry
from tidemark.queries import dating, grouping, planning, reporting  # noqa: F401  (they register their queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: orders as assets, from claims to verdicts to the census of destinations."""
    return planning.target_path(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
