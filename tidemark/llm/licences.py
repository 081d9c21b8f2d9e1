"""Licence scans by canonical digest, in DataFrame operations only.

A text is made canonical (A-Z lower-cased, lines that state a copyright dropped, all but letters and digits of any script turned to
single blanks, equivalent spellings made one) and its SHA-256 is looked up, by a hash join, in the digests of known licence texts,
made canonical in the same way. Each line, taken as a text, is looked up in the digests of one-line notices as well. A text is
made canonical once, with its lines kept apart until both look-ups are served, and no row moves between tasks.

Known are the texts of TEXTS, and by their digests alone the long ones of DIGESTS. Headers of source files that name a licence are texts of their own.

Defined cases: an empty table gives an empty result; very long texts are looked up whole; of two licences with one canonical text the first by name is given; a null text is like an empty one, whose canonical form is empty and which no licence has; repeated rows and null
ids are kept, each with its result; extra columns pass through, but for those named like the three results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Aside, lowered
from .licence_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

#: A line that states a copyright: its first word is one of these.
COPYRIGHT_LINE = r"(?md)^[^a-z0-9\n©]*(copyright|\(c\)|©)[^\n]*$"
#: What parts words within a line; a lone blank does so already and is left as it is.
_PARTS = r"\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F©"
_NOT_WORD = rf"[{_PARTS}&&[^ ]][{_PARTS}]*| [{_PARTS}]+"
_VARIANT = "( " + " | ".join(SPELLINGS) + " )"


def _words(text: Column) -> Column:
    """The words of a text, and its line ends as words of their own, each between blanks."""
    bare = F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    return F.concat(F.lit(" "), F.replace(F.regexp_replace(bare, _NOT_WORD, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))


def _spelt(words: Column) -> Column:
    """Equivalent spellings made one. Few texts have any of them; the others keep their words as they are."""
    pairs = [F.lit(x) for pair in SPELLINGS.items() for x in pair]
    same = F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.element_at(F.create_map(*pairs), w), w)), " ")
    return F.when(words.rlike(_VARIANT), same).otherwise(words)


def _digest(words: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(words, r" [ \n]+", " ")), 256)


def digest(text: Column) -> Column:
    return _digest(_spelt(_words(text)))


def known(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(digest, licence) of named texts; a few dozen rows."""
    rows = F.explode(F.array(*[F.struct(F.lit(text).alias("text"), F.lit(name).alias("licence")) for text, name in texts.items()]))
    return spark.range(1).select(rows.alias("r")).select(digest(F.col("r.text")).alias("digest"), "r.licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """docs(text, ...) with digest, licence (of the entire text, or null) and notices, the sorted licences of its lines."""
    spark = docs.sparkSession
    whole = known(spark, {text: name for name, text in TEXTS.items()} if texts is None else texts)
    if texts is None:
        whole = whole.unionByName(spark.createDataFrame([(digest, name) for name, digest in DIGESTS], whole.schema))
    # As many digests as notices were given: few enough for an expression.
    of_line = [F.lit(x) for row in known(spark, NOTICES if notices is None else notices).collect() for x in row]
    aside, words = Aside(docs, ("text",), ("digest", "licence", "notices")), "_words"
    rows = aside.rows.withColumn(words, _words(F.col("text"))).withColumn(words, _spelt(F.col(words)))
    named = F.array().cast("array<string>")
    if of_line:
        named = F.transform(F.split(words, "\n"), lambda line: F.element_at(F.create_map(*of_line), _digest(line)))
    found = rows.select(*aside.carry, _digest(F.col(words)).alias("digest"), F.array_sort(F.array_distinct(F.array_compact(named))).alias("notices"))
    return aside.restored(found.join(F.broadcast(whole), "digest", "left"), "digest", "licence", "notices")
