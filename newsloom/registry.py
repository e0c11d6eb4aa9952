"""Names of all queries of the core, with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans import catalog


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentences of each topic by n-gram scores."""
    return catalog.topic_top20(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
