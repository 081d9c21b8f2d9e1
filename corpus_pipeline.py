"""The corpus pipeline: documents through five of the training-text operators, each stage written and read again.

Defined cases: a null or empty text has no words: it isn't toxic, has no language and so goes in the second stage; of repeated rows and
equal texts one stays in the third; null ids are kept like others; an empty table gives an empty result; very long texts are judged whole;
extra columns pass through all stages, whatever their names, but for the two that the last one adds (size, copy_no), which it replaces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, mixing, near_texts
from tidemark.llm import toxicity as toxic
from tidemark.llm.common import Aside, bounded_batches, shared_dir, table

#: Least share of a text's words in its language; below it the text is of no language.
LEAST_LANGUAGE = 0.4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, learned from the labelled ones, doesn't predict to be toxic."""
    bounded_batches(spark)
    tagger = toxic.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    aside = Aside(docs, ("text",))
    return aside.restored(toxic.tag(aside.rows, tagger, aside.carry).where("predicted = 0"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not those without a letter, or of which no language has its share of the words."""
    bounded_batches(spark)
    aside = Aside(docs, ("doc_id", "text", "lang"))
    found = language.identify(aside.rows, aside.carry)
    return aside.restored(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicate texts."""
    bounded_batches(spark)
    aside = Aside(docs, ("doc_id", "text"))
    return aside.restored(near_texts.unique_texts(aside.rows))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark passages."""
    aside = Aside(docs, ("text",))
    return aside.restored(decontaminate.decontaminate(aside.rows, table(spark, sf_dir, "benchmark")).where("NOT contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: a row for each copy taken, with the document's size and the copy's number."""
    aside = Aside(docs, ("doc_id", "text", "source"), ("size", "copy_no"))
    return aside.restored(mixing.emitted(mixing.mix(aside.rows)), "size", "copy_no")


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each from what the one before it wrote to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The first two stages are fitted models, which SQL can't express.
ORACLE_SQL = None
