"""All registered queries outside the training-text subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import claims, decisions, imports, markets, more, news, prices, reads, relevance, text, topics

MODULES = [prices, text, decisions, more, news, reads, relevance, claims, imports, markets, topics]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
