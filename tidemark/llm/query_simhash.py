"""op5: classes of near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .simhash import fingerprints, hexed, near_classes


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return near_classes(fingerprints(docs)).select("doc_id", hexed("fp").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": simhash}
SQL: dict[str, str] = {}
