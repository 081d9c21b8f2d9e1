"""Queries of the training-text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import query_chat, query_decontaminate, query_hmm, query_language, query_licences, query_media, query_mixing, query_pieces, query_resampling, query_simhash, query_toxicity, query_urls, query_vector_codes

MODULES = [query_mixing, query_decontaminate, query_simhash, query_hmm, query_language, query_toxicity, query_media, query_urls, query_chat, query_licences, query_pieces, query_vector_codes, query_resampling]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
