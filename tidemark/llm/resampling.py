"""Importance resampling towards a target: documents drawn without repetition, likelier the more their n-grams look like the target's.

Hashed n-grams of both sides are counted over all texts by bucket, in the tasks first; a bucket's gain is a thousand times the logarithm of the smoothed ratio of
its shares, rounded down. In a second pass over the texts each occurrence gathers the gain of its n-gram's bucket (grams.GramTable), and a document's
weight is the floored mean. With noise from the document's id added (Gumbel's, so that a draw of the highest scores is one by
weight without repetition) the documents are sorted over ranges, and the rank is the place in the range plus the rows of all earlier ones.

Defined cases: a null text has no words; a document without words has weight 0; a null id counts as an empty string and comes last among equal scores; repeated rows are documents
of their own; very long texts are taken whole; an empty target or table gives gains from the smoothing alone; carried columns named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import crf
from .common import Aside, stored
from .grams import GramTable, Spans

BUCKETS, LONGEST, SEED = 10_000, 2, 7
#: The share drawn, of documents with so many words at least; bytes of text whose n-grams are held at once.
PERCENT, LEAST_WORDS, AT_ONCE = 25, 20, 1 << 19
RESULTS = ("n_features", "weight", "score", "rank")


def _batches(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[pa.RecordBatch, Spans]]:
    """Parts of the batches and their spans; the text is the last column."""
    for batch in crf.shortened(batches):
        data, cuts = crf.texts_of(batch.column(batch.num_columns - 1))
        for a, b in crf.pieces(data, cuts, AT_ONCE):
            yield batch.slice(a, b - a), Spans(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a], longest)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Occurrences of n-grams in all texts, by bucket: as many numbers as there are buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, spans in _batches(batches, longest):
            total += GramTable(spans, buckets).by_bucket(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counts = docs.select(F.col("text").cast("binary").alias("_body")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket from the counts of both sides."""
    n = len(docs)
    s, t = docs.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(text, ...) -> the carried columns, n_words, n_features and weight."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(*carry, F.col("text").cast("binary").alias("_body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch, spans in _batches(batches, longest):
            table = GramTable(spans, len(gain))
            own = gain[table.bucket][table.slot]
            total = np.bincount(spans.text, weights=own, minlength=batch.num_rows).astype(np.int64)
            n = np.bincount(spans.text, minlength=batch.num_rows)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(spans.words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], names=[*batch.schema.names[:-1], "n_words", "n_features", "weight"]
            )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, kinds + "n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times Gumbel noise from the id's digest, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, keys: list[Column], most: int) -> DataFrame:
    """The rows with rank, the place by keys from 1 to `most`, null after that; they are sorted over ranges, and no task gets more than its range."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = stored(rows.orderBy(*keys).select("*", F.spark_partition_id().alias("_range"), place.alias("_place")), "ranges")
    # As many rows as there are ranges.
    sizes = dealt.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_of")) - F.col("_n")
    rank = F.col("_before") + F.col("_place") + 1
    found = dealt.join(F.broadcast(sizes.select("_of", before.alias("_before"))), F.col("_range") == F.col("_of"))
    return found.select(*rows.columns, F.when(rank <= most, rank).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, carry: tuple[str, ...] = ("doc_id",), percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST
) -> DataFrame:
    """docs(doc_id, text, ...) and target(text) -> the carried columns and RESULTS of every document; rank is null for those not drawn."""
    aside = Aside(docs, ("doc_id", "text"), RESULTS, carry)
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    own = aside.rows.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(aside.carry)], F.col("doc_id").alias("_id"), "text")
    kept = tuple(c for c in own.columns if c != "text")
    weighed = stored(weigh(own, gain, longest, kept).withColumn("score", F.col("weight") + noise(F.col("_id"), seed)), "weighed")
    able = F.col("n_words") >= least_words
    drawn = ranked(weighed.where(able), [F.desc("score"), F.asc_nulls_last("_id")], percent * weighed.where(able).count() // 100)
    found = drawn.unionByName(weighed.where(~able).withColumn("rank", F.lit(None).cast("bigint")))
    return aside.restored(found.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(aside.carry)], *RESULTS), *RESULTS)
