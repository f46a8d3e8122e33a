"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setaccio.plans import corpus_queries, text_queries

_MODULES = (text_queries, corpus_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.curate_heuristic_dedup(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
