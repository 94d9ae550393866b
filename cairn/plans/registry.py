"""All queries of the catalog engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.plans import catalog_queries, ingest_queries  # noqa: F401  registers its queries

FLAGSHIP = "f1_fts_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog_queries.ORACLE)
