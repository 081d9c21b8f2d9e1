"""op10: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fold, table
from .toxicity import tag, train


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    tagger = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return tag(docs, tagger, ("doc_id",)).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "spans")


QUERIES = {"op10_toxicity": toxicity}
SQL: dict[str, str] = {}
