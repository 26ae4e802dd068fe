"""The queries of the engine's own operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import folds, graphs, reads, searches, tables, writes  # noqa: F401  (they register their queries)
from .plans.registry import QUERIES, SQL, Query, Tables


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return reads.flagship(Tables(spark, folder))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
