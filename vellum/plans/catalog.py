"""Every query of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import further_queries, log_queries, predicate_queries, registry, relation_queries, scan_queries, symbol_queries, text_queries  # noqa: F401  (importing registers their queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["log_repo_rollup"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
