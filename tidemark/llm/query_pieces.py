"""op12: sentence pieces of all documents, and their texts back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pieces import decode, encode

MODEL = "piece_bpe_32k.model"


def vocabulary(name: str = MODEL) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and spans of every document, decoded again; their numbers and digests."""
    path = vocabulary()
    encoded = encode(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    decoded = decode(encoded, path, ("doc_id", "ids"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op12_piece_codes": piece_codes}
SQL: dict[str, str] = {}
