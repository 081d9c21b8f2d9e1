"""Merges of an incoming batch into stored rows. Each returns the rows to write; a table format is the caller's choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in the given order over both sides; `_incoming` (1 or 0) may be used in it."""
    both = existing.withColumn("_incoming", F.lit(0)).unionByName(incoming.withColumn("_incoming", F.lit(1)))
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k", "_incoming")


def status_rank(status: Column) -> Column:
    return F.when(status == "complete", 3).when(status == "preliminary", 2).otherwise(1)


def upsert_reactions(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """A higher status wins; of equal ones the one observed last, the incoming at a tie."""
    return upsert(existing, incoming, keys, [status_rank(F.col("status")).desc(), F.col("observed_at").desc(), F.col("_incoming").desc()])


def upsert_last(existing: DataFrame, incoming: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The incoming row that arrived last, else the stored one."""
    return upsert(existing, incoming, keys, [F.col("_incoming").desc(), F.col(arrival).desc()])


def replace_groups(existing: DataFrame, incoming: DataFrame, group: str, keys: list[str], kept: list[str]) -> DataFrame:
    """Within the groups that the batch touches its rows replace the stored ones; columns in kept stay as stored where the key was there. Other groups stay."""
    touched = incoming.select(group).distinct()
    stored_cols = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in kept])
    new = incoming.join(stored_cols, keys, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in kept else F.col(c) for c in incoming.columns])
    return existing.join(touched, group, "left_anti").unionByName(new)


def keep_newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def retain(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows of the last days; those without a time stay."""
    return rows.where(F.col(ts).isNull() | (F.col(ts) >= now - F.make_interval(days=F.lit(days))))


def retain_with_edges(rows: DataFrame, edges: DataFrame, key: str, ts: str, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """The kept rows, and the edges whose source id up to its first colon isn't that of a row that went."""
    kept = retain(rows, ts, now, days)
    gone = rows.join(kept.select(key), key, "left_anti").select(F.col(key).cast("string").alias("_source"))
    left = edges.withColumn("_source", F.substring_index("source_id", ":", 1)).join(gone, "_source", "left_anti").drop("_source")
    return kept, left


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those incoming ones whose key is new, the first by all columns of each key."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    one = fresh.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c) for c in incoming.columns if c not in keys]))).where("_k = 1").drop("_k")
    return existing.unionByName(one)


def merge_snapshots(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily snapshots(day, generated_at, payload): (merged, refused). One may not go back in time, nor change at an equal time."""
    old = existing.select("day", F.col("generated_at").alias("_at"), F.col("payload").alias("_payload"))
    judged = incoming.join(old, "day", "left").withColumn("_bad", F.coalesce((F.col("generated_at") < F.col("_at")) | ((F.col("generated_at") == F.col("_at")) & (F.col("payload") != F.col("_payload"))), F.lit(False)))
    good = judged.where("NOT _bad").drop("_at", "_payload", "_bad")
    return existing.join(good.select("day"), "day", "left_anti").unionByName(good), judged.where("_bad").drop("_at", "_payload", "_bad")


def versions(history: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """Revisions of each key: rows whose body differs from the one before, numbered, with the time at which the next replaced them."""
    w = Window.partitionBy(key).orderBy(order)
    changed = history.withColumn("_before", F.lag(body).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(body))).drop("_before")
    return changed.withColumn("revision", F.row_number().over(w)).withColumn("valid_to", F.lead(order).over(w))


def merge_sightings(rows: DataFrame) -> DataFrame:
    """Observations(event_id, kol_key, source, source_url, published_at, time_status, seen_at) by identity: counts, first and last seen, and the publication of the best status, the first to have it."""
    rank = F.when(F.col("time_status") == "verified", 0).when(F.col("time_status") == "future", 1).otherwise(2)
    first = F.min_by(F.struct("time_status", "published_at"), F.struct(rank, "seen_at", "published_at"))
    keys = ["event_id", "kol_key", "source", "source_url"]
    merged = rows.groupBy(*keys).agg(F.count("*").alias("observations"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), first.alias("p"))
    return merged.select(*keys, "observations", "first_seen", "last_seen", "p.time_status", "p.published_at")


def publication_status(published: Column, observed: Column, skew_seconds: int = 300) -> Column:
    """verified, future (more than the skew ahead of the observation) or unknown."""
    return F.when(published.isNull(), "unknown").when(F.unix_seconds(published.cast("timestamp")) > F.unix_seconds(observed.cast("timestamp")) + skew_seconds, "future").otherwise("verified")
