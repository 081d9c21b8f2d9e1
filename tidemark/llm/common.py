"""Shared helpers: scratch storage all executors can read, table access, held-out folds, columns set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import shared_dir, stored
from ..sources.tables import table

__all__ = ["LOWER", "UPPER", "WORD", "Aside", "bounded_batches", "fold", "lowered", "shared_dir", "stored", "table", "window_at", "with_body"]

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """Only A-Z lower-cased; other letters keep their case. Where no other letter has a case to lose, lower does it, and faster."""
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(other) == other, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


class Aside:
    """A table's columns under plain names while an operator works on them.

    rows has the needed columns under their own names and every other kept column under a number, so that no name of the operator's can
    clash with one of the table's. restored gives the kept columns their names back and adds results; a column of the table
    that is named like a result (in any case) is replaced by it.
    """

    def __init__(self, df: DataFrame, needed: tuple[str, ...], results: tuple[str, ...] = (), carry: tuple[str, ...] | None = None):
        gone = {name.lower() for name in results}
        self.kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in gone]
        self.names = {c: c if c in needed else f"_{k}" for k, c in enumerate(self.kept)}
        also = [c for c in needed if c not in self.names]
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        self.rows = df.select(*[quoted(c).alias(self.names[c]) for c in self.kept], *also)
        #: The kept columns' names within rows, for mapInArrow and the like.
        self.carry = tuple(self.names.values())

    def restored(self, found: DataFrame, *results: Column | str) -> DataFrame:
        return found.select(*[F.col(self.names[c]).alias(c) for c in self.kept], *results)


#: Bytes and rows of the batches that workers get, so that what a worker holds at once doesn't grow with the texts.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_BYTES bytes and BATCH_ROWS rows at most; smaller settings stay. A single text may be larger."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in now or "" if c.isdigit())
        if now != digits or not digits or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def window_at(size: Column, most: int, *by: Column) -> Column:
    """Where, counted from 1, a window of `most` begins in something of a size: chosen by digest, at 1 where all of it fits."""
    return (F.pmod(F.xxhash64(*by, F.lit(3)), F.greatest(size - most + 1, F.lit(1))) + 1).cast("int")


def with_body(docs: DataFrame, carry: tuple[str, ...], results: str, *more: Column) -> tuple[DataFrame, StructType, str]:
    """(carried columns, the text for a task and more, the schema of the carried columns and the results, the column that has the text)."""
    schema = StructType([docs.schema[c] for c in carry])
    for field in StructType.fromDDL(results):
        schema = schema.add(field)
    if "text" in carry:
        return docs.select(*carry, *more), schema, "text"
    return docs.select(*carry, F.col("text").cast("binary").alias("_body"), *more), schema, "_body"
