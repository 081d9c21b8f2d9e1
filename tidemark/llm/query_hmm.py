"""op4: hidden Markov scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .hmm import score


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op4_lm_scores": lm_scores}
SQL: dict[str, str] = {}
