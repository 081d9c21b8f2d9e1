"""Document frequencies of words by label, over whole tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf

_FLUSH = 150_000  # distinct keys that a task counts before it passes them on


def document_keys(rows: DataFrame, label: str, starts: tuple[int, ...] = ()) -> DataFrame:
    """rows(label, body) -> (label, hash, n): in how many texts of a label each lexicon key occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[tuple] = Counter()

        def flushed() -> pa.RecordBatch:
            keys = list(count)
            columns = [pa.array([k for k, _ in keys], kind), pa.array(np.array([h for _, h in keys], np.uint64).view(np.int64)), pa.array(list(count.values()), pa.int64())]
            count.clear()
            return pa.RecordBatch.from_arrays(columns, names=[label, "hash", "n"])

        for batch in crf.shortened(batches):
            kind = batch.column(0).type
            labels = batch.column(0).to_pylist()
            data, cuts = crf.texts_of(batch.column(1))
            for a, b in crf.pieces(data, cuts):
                words = crf.Words(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
                keys = words.keys(starts)
                ends = np.cumsum(words.per_text)
                for i, (end, n) in enumerate(zip(ends.tolist(), words.per_text.tolist(), strict=True)):
                    own = np.unique(np.concatenate([k[end - n : end] for k in keys]))
                    count.update((labels[a + i], h) for h in own[own > 0].tolist())
                if len(count) >= _FLUSH:
                    yield flushed()
        if count:
            yield flushed()

    kind = rows.schema[label].dataType.simpleString()
    return rows.select(label, "body").mapInArrow(run, f"{label} {kind}, hash bigint, n bigint").groupBy(label, "hash").agg(F.sum("n").alias("n"))


def coarse(n: Column) -> Column:
    """n with all but its eight leading bits made zero: at most some 7,300 values of a long."""
    return F.call_function("shiftleft", F.call_function("shiftright", n, F.greatest(F.length(F.bin(n)) - 8, F.lit(0))), F.greatest(F.length(F.bin(n)) - 8, F.lit(0)))


def least_counts(counts: DataFrame, label: str, most: int) -> DataFrame:
    """(label, least): the least coarse count that at most `most` rows of counts(label, n) reach, null if none.

    Decided on the number of rows for each coarse count, a bounded array a label, so neither a window nor the driver gets rows.
    """
    steps = counts.groupBy(label, coarse(F.col("n")).alias("step")).agg(F.count("*").alias("rows"))
    downward = F.sort_array(F.collect_list(F.struct("step", "rows")), asc=False)
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("least"))

    def further(so_far: Column, step: Column) -> Column:
        upto = so_far["upto"] + step["rows"]
        return F.struct(upto.alias("upto"), F.when(upto <= most, step["step"]).otherwise(so_far["least"]).alias("least"))

    return steps.groupBy(label).agg(F.aggregate(downward, start, further)["least"].alias("least"))


def most_frequent(counts: DataFrame, label: str, most: int) -> DataFrame:
    """The rows of counts(label, hash, n) with the greatest n of each label: all that share a coarse count or none, `most` of a label at most."""
    return counts.join(F.broadcast(least_counts(counts, label, most)), label).where("n >= least").drop("least")


def about(value: Column, label: Column, sizes: dict, most: int) -> Column:
    """Whether a row is in a sample of about `most` rows of each label (a fifth more, at first), by the hash of value; sizes: all rows of a label."""
    rate = F.lit(0.0)
    for name, n in sizes.items():
        rate = F.when(label == name, F.lit(min(1.0, 1.2 * most / max(1, n)))).otherwise(rate)
    return F.pmod(F.xxhash64(value, F.lit(17)), F.lit(1 << 30)) < rate * float(1 << 30)
