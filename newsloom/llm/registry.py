"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import encoding, leaks, lines, near, quality, sentences, spans, terms

MODULES = (sentences, terms, near, lines, spans, encoding, leaks, quality)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
