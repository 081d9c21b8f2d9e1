"""Segments of transcripts: chunks of bounded length, durations, checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a chunk; least segments and characters, least seconds, most speakers, least turns of the one who speaks most. Fixed values.
CHUNK = 11_000
SEGMENTS, CHARACTERS, SECONDS, SPEAKERS, TURNS = 20, 2000, 60, 12, 3


def chunks(segments: DataFrame, most: int = CHUNK) -> DataFrame:
    """segments(doc, at, text) -> (doc, at, part, chunk): in order into chunks of at most so many characters, a longer text cut into parts of that many first.

    A chunk begins where the ones before leave off, so the lengths of a document go in order through one task, which keeps only how full the chunk is; no document is gathered,
    and texts stay behind. Empty texts are in no chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, chunk, used = object(), 0, 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.doc != doc and not (pd.isna(row.doc) and doc is None):
                    doc, chunk, used = None if pd.isna(row.doc) else row.doc, 0, 0
                for part, start in enumerate(range(0, row.n, most)):
                    size = min(most, row.n - start)
                    if used and used + size > most:
                        chunk, used = chunk + 1, 0
                    used += size
                    out.append((row.doc, row.at, part, chunk))
            yield pd.DataFrame(out, columns=["doc", "at", "part", "chunk"])

    rows = segments.select("doc", F.col("at").cast("bigint").alias("at"), F.length("text").alias("n")).where("n > 0")
    return rows.repartition("doc").sortWithinPartitions("doc", "at", "n").mapInPandas(run, f"doc {segments.schema['doc'].dataType.simpleString()}, at bigint, part int, chunk int")


def split_oversize(segments: DataFrame, most: int = CHUNK) -> DataFrame:
    """(doc, at, part, text): texts cut into pieces of at most so many characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / most))
    parts = segments.withColumn("part", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return parts.withColumn("text", F.substr("text", F.col("part") * most + 1, F.lit(most)))


def duration(text: Column) -> Column:
    """Seconds of h:m:s, m:s or s; null if it is something else."""
    total = F.aggregate(F.split(text, ":"), F.lit(0).cast("bigint"), lambda acc, x: acc * 60 + F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.when(text.rlike("^[0-9]+(:[0-9]{1,2}){0,2}$"), total)


def validated(segments: DataFrame, segments_: int = SEGMENTS, characters: int = CHARACTERS) -> DataFrame:
    """segments(doc, at, start, end, speaker, text) -> (doc, segments, speakers, seconds, valid): enough segments and text, starts that don't fall, no empty text, no end
    before its start, a minute at least, so many speakers at most, one of whom speaks three times."""
    w = Window.partitionBy("doc").orderBy("at")
    fits = F.coalesce(F.col("start") >= F.lag("start").over(w), F.lit(True)) & (F.trim("text") != "") & F.coalesce(F.col("end") > F.col("start"), F.lit(True))
    by_speaker = segments.withColumn("_fits", F.coalesce(fits, F.lit(False))).groupBy("doc", "speaker").agg(
        F.count("*").alias("turns"), F.sum(F.length("text")).alias("n"), F.min("start").alias("a"), F.max("start").alias("b"), F.bool_and("_fits").alias("ok")
    )
    found = by_speaker.groupBy("doc").agg(
        F.sum("turns").alias("segments"), F.count("*").alias("speakers"), (F.max("b") - F.min("a")).alias("seconds"), F.max("turns").alias("_most"), F.sum("n").alias("_n"), F.bool_and("ok").alias("_ok")
    )
    valid = F.col("_ok") & (F.col("segments") >= segments_) & (F.col("_n") >= characters) & (F.col("seconds") >= SECONDS) & (F.col("speakers") <= SPEAKERS) & (F.col("_most") >= TURNS)
    return found.withColumn("valid", valid).drop("_most", "_n", "_ok")


def with_ends(segments: DataFrame) -> DataFrame:
    """Adds end, the next later start of the same document."""
    w = Window.partitionBy("doc").orderBy("start").rangeBetween(1, Window.unboundedFollowing)
    return segments.withColumn("end", F.min("start").over(w))
