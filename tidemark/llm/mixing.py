"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / size of the source. Documents
are numbered within their source in order of size, so the running sum of expected copies is that ratio times
the number; one offset per source is added and a copy is emitted for each integer that the sum crosses. Going by
size keeps the words taken within about one document's size of the target.

A source may hold any share of all rows: no window runs over the rows of a source. Rows are counted by (source,
size, bucket of the id and the text), the counts are summed up within (source, size) and over the sizes of a source, and only the
rows of one such bucket are numbered together. The windows over sources alone run over one row a source.

Defined cases: a null or blank text has size 0 and is sampled like any other; a null source is a source of its own, after
all others; a null id is the empty string, and a null text like an empty one, when rows are dealt to buckets; rows of one id are told apart by their texts, so reruns
take the same texts, and rows equal in id, text and source take each other's place; very long texts are counted whole; an
empty table gives an empty result; other columns pass through, but for those named like a result (in any case), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Aside, stored

#: Weights that the sources take in turn, in order of code point.
WEIGHTS = (3, 1, 2)
#: Words to take, as thousandths of all words, and the most that one source may give, as a multiple of its size.
SHARE, MOST = 1500, 2
RESULTS = ("size", "source_size", "target", "copies", "taken")
_HEX = 3  # hex digits of the bucket: 4096 buckets for each size of a source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(_src, _none, source_size) -> the same with target: words by weight, none above `most` times its size.

    Filling stops first where size / weight is least, so in that order a source is at its limit exactly if its
    share of what the ones before it leave is above the limit. Whole numbers decide; one division gives the target.
    """
    lcm = 1
    for w in weights:
        lcm = lcm * w if lcm % w else lcm
    rank = F.row_number().over(Window.orderBy("_none", "_src")) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    before = Window.orderBy("_order", "_none", "_src").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_order", "_none", "_src").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("_order", "_none", "_src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    big = lambda c: c.cast("decimal(19,0)")
    ranked = sizes.withColumn("_w", w).withColumn("_order", F.col("source_size") * (F.lit(lcm) / F.col("_w")).cast("long"))
    filled = (
        ranked.withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_used", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        .withColumn("_left_w", F.sum("_w").over(after))
        .withColumn("_full", big(F.col("_w")) * big(F.col("_all") * share - F.col("_used") * 1000) > big(F.col("source_size") * most * 1000) * big(F.col("_left_w")))
    )
    # What the sources at their limit use and the weight of the others are the same for all sources.
    limited = filled.withColumn("_used_all", F.coalesce(F.sum(F.when(F.col("_full"), F.col("source_size") * most)).over(every), F.lit(0))).withColumn(
        "_free_w", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every), F.lit(1))
    )
    words = (F.col("_w") * (F.col("_all") * share - F.col("_used_all") * 1000)).cast("double") / (F.col("_free_w") * 1000).cast("double")
    return limited.select("_src", "_none", "source_size", F.when(F.col("_full"), (F.col("source_size") * most).cast("double")).otherwise(words).alias("target"), "_full")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, seed: str = "mix", carry: tuple[str, ...] | None = None) -> DataFrame:
    """docs(doc_id, text, source, ...) (or their columns in carry) with size, source_size, target, copies and taken added."""
    aside = Aside(docs, ("doc_id", "text", "source"), RESULTS, carry)
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows = aside.rows.withColumns(
        {
            "_src": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_none": F.col("source").isNull(),
            "size": word_count(F.col("text")),
            "_key": F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest),
        }
    ).withColumn("_bucket", F.substring(F.md5(F.col("_key")), 1, _HEX))
    if "text" not in aside.carry:
        # Without the text a row is small, and its words need no second counting.
        rows = stored(rows.drop("text"), "sized")
    key = ["_src", "_none"]
    counts = rows.groupBy(*key, "size", "_bucket").agg(F.count("*").alias("_n"))
    in_size = Window.partitionBy(*key, "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = counts.withColumn("_before", F.coalesce(F.sum("_n").over(in_size), F.lit(0)))
    by_size = counts.groupBy(*key, "size").agg(F.sum("_n").alias("_n"))
    in_source = Window.partitionBy(*key).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    smaller = by_size.withColumn("_smaller", F.coalesce(F.sum("_n").over(in_source), F.lit(0))).drop("_n")
    sizes = by_size.groupBy(*key).agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    starts = by_bucket.join(smaller.join(targets, key), [*key, "size"]).select(*key, "size", "_bucket", (F.col("_before") + F.col("_smaller")).alias("_start"), "source_size", "target", "_full")
    group = Window.partitionBy(*key, "size", "_bucket").orderBy("_key")
    numbered = rows.withColumn("_row", F.row_number().over(group)).join(starts, [*key, "size", "_bucket"])
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_src"))), 1, 4), 16, 10).cast("double") + 0.5) / 65536.0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    at = lambda n: F.floor(ratio * n.cast("double") + offset)
    crossed = F.least(at(F.col("_start") + F.col("_row")) - at(F.col("_start") + F.col("_row") - 1), F.lit(most))
    copies = F.when(F.col("_full"), F.when(F.col("source_size") > 0, F.lit(most)).otherwise(F.lit(0))).otherwise(crossed).cast("long")
    return aside.restored(numbered.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")), *RESULTS)


def emitted(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, numbered from 1 in copy_no."""
    taken = mixed.where(F.col("copies") > 0)
    return taken.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
