"""op8: all documents as media of a chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .media import media_features


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_features(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op8_media_chunks": media}
SQL: dict[str, str] = {}
