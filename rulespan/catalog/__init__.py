"""All queries of the rule engine, by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulespan.catalog import conditions, files, gaps, identity, logs, pairs, registry, review, signing
from rulespan.catalog.base import QUERIES, SQL

__all__ = ["conditions", "files", "gaps", "identity", "logs", "oracle_sql", "pairs", "queries", "registry", "review", "signing"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
