"""Stories: the best sighting of an event, duplicate titles, classes of items that share an alias, merged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import titles
from ..functions.urls import canonical_url
from .components import components


def best_per_group(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k")


def sighting_order() -> list[Column]:
    """Verified time first, then the owner's own post, then the latest verified publication or else first sight, last sight, and id."""
    verified = F.col("time_status") == "verified"
    return [verified.desc(), F.col("owned_direct").desc(), F.when(verified, F.col("published_at")).desc_nulls_last(), F.when(~verified, F.col("first_seen")).desc_nulls_last(), F.col("last_seen").desc(), F.col("sighting_id").desc()]


def dedup_exact(items: DataFrame) -> DataFrame:
    """Items(item_id, title, url, ...) by dedup key: (dedup_key, keep_id, members, longest title)."""
    keyed = items.withColumn("dedup_key", titles.dedup_key(F.col("title"), F.col("url")))
    longest = F.max_by("title", F.struct(F.length("title"), -F.col("item_id")))
    return keyed.groupBy("dedup_key").agg(F.min("item_id").alias("keep_id"), F.count("*").alias("members"), longest.alias("title"))


def prefix_twins(items: DataFrame) -> DataFrame:
    """The twins among the items' normal titles."""
    return twins(items.select(titles.normal_title(F.col("title")).alias("plain")).distinct())


def twins(plain: DataFrame) -> DataFrame:
    """Pairs of distinct normal titles of which the longer starts with the shorter, both long enough: (long, short).

    A title's starts, of the lengths that titles with its first letters have, are looked up among the titles by their hash, so no bucket of a common
    start is joined with itself.
    """
    plain = plain.where(F.length("plain") >= titles.LEAST)
    bucket = F.xxhash64(F.left("plain", F.lit(titles.LEAST)))
    lengths = plain.groupBy(bucket.alias("bucket")).agg(F.collect_set(F.length("plain")).alias("lengths"))
    starts = plain.select(F.col("plain").alias("long"), bucket.alias("bucket")).join(lengths, "bucket").select("long", F.explode(F.filter("lengths", lambda n: n < F.length("long"))).alias("n"))
    asked = starts.select("long", "n", F.xxhash64(F.expr("left(long, n)")).alias("hash"))
    met = asked.join(plain.select(F.col("plain").alias("short"), F.xxhash64("plain").alias("hash")), "hash")
    return met.where(F.col("long").startswith(F.col("short")) & (F.col("long") != F.col("short"))).select("long", "short")


def fold_prefixes(items: DataFrame) -> DataFrame:
    """(item_id, class_title): the longest title that starts with an item's (of equal ones the last by code point), which names its class of twins."""
    longest = prefix_twins(items).groupBy(F.col("short").alias("plain")).agg(F.max_by("long", F.struct(F.length("long"), "long")).alias("root"))
    named = items.select("item_id", titles.normal_title(F.col("title")).alias("plain"))
    return named.join(longest, "plain", "left").select("item_id", F.coalesce("root", "plain").alias("class_title"))


def alias_classes(aliases: DataFrame) -> DataFrame:
    """(item_id, alias) -> (item_id, class_id): items that share aliases, also over others, in one class, named by its least item.

    Items and aliases are the two kinds of nodes of one graph, so a popular alias links each of its items once.
    """
    named = aliases.where(F.col("alias").isNotNull()).select(F.concat(F.lit("i"), F.lpad("item_id", 20, "0")).alias("u"), F.concat(F.lit("~"), "alias").alias("v"))
    roots = components(named).where(F.col("node").startswith("i"))
    own = aliases.select("item_id").distinct().withColumn("node", F.concat(F.lit("i"), F.lpad("item_id", 20, "0")))
    return own.join(roots, "node", "left").select("item_id", F.coalesce(F.substring("root", 2, 20).cast("long"), F.col("item_id")).alias("class_id"))


def source_counts(sightings: DataFrame) -> DataFrame:
    """(event_id, sources): distinct URLs that aren't blank, one at least."""
    url = F.trim("source_url")
    return sightings.groupBy("event_id").agg(F.greatest(F.lit(1), F.count_distinct(F.when(url != "", url))).alias("sources"))


def siblings(events: DataFrame, most: int = 12) -> DataFrame:
    """(event_id, cluster_key, ts) -> each event's newest others of its cluster: (event_id, sibling_id, k), `most` of them.

    Only the newest most + 1 of a cluster can be anyone's siblings.
    """
    newest = Window.partitionBy("cluster_key").orderBy(F.desc("ts"), F.desc("event_id"))
    top = events.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= most + 1).select("cluster_key", F.col("event_id").alias("sibling_id"), "_k")
    pairs = events.select("event_id", "cluster_key").join(top, "cluster_key").where("event_id <> sibling_id")
    ranked = pairs.withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy("_k")))
    return ranked.where(F.col("k") <= most).select("event_id", "sibling_id", "k")


def merged_stories(members: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Members(class, item_id, tier, impact, ts, url) to one row: base by tier, greatest impact, latest time, distinct urls in order."""
    base = F.min_by("item_id", F.struct(-F.col("tier"), -F.unix_micros(F.col("ts").cast("timestamp")), "item_id"))
    urls = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "url"))), lambda x: x["url"]))
    return members.groupBy(class_id).agg(base.alias("base_id"), F.max("impact").alias("impact"), F.max("ts").alias("updated"), F.count("*").alias("members"), F.size(urls).alias("urls"))


def _collapsed(rows: DataFrame) -> DataFrame:
    """Stored sightings by identity: observations summed, first and last sight, the publication of the best status; of equal ones that of a row that was there, then of the first seen."""
    rank = F.when(F.col("time_status") == "verified", 0).when(F.col("time_status") == "future", 1).otherwise(2)
    best = F.min_by(F.struct("time_status", "published_at"), F.struct(rank, "_moved", "first_seen", "published_at"))
    keys = ["event_id", "kol_key", "source", "source_url"]
    merged = rows.groupBy(*keys).agg(F.sum("observations").alias("observations"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), best.alias("p"))
    return merged.select(*keys, "observations", "first_seen", "last_seen", "p.time_status", "p.published_at")


def moved_sightings(sightings: DataFrame, moves: DataFrame) -> DataFrame:
    """Stored sightings after moves(event_id, keep_id) of duplicate events to those that stay; rows of one identity become one."""
    j = sightings.join(moves, "event_id", "left").withColumn("_moved", F.col("keep_id").isNotNull())
    return _collapsed(j.withColumn("event_id", F.coalesce("keep_id", "event_id")))


def canonical_sightings(sightings: DataFrame) -> DataFrame:
    """Stored sightings by their canonical urls (as they are, where there is none); rows that then share an identity become one."""
    j = sightings.withColumn("_url", F.coalesce(canonical_url(F.col("source_url")), F.col("source_url")))
    return _collapsed(j.withColumn("_moved", F.col("_url") != F.col("source_url")).withColumn("source_url", F.col("_url")))
