"""Observations as a stream: undated and future ones are set aside, the others are merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store
from ..sources.scratch import shared_dir

SCHEMA = "event_id bigint, kol_key string, source string, source_url string, published_at timestamp, seen_at timestamp"


def observations(spark: SparkSession, landing: str, most_files: int = 100) -> DataFrame:
    """The stream of a landing folder of Parquet files, with time_status; late rows are kept, so the watermark is on the ingest time only."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", most_files).parquet(landing)
    marked = raw.withColumn("time_status", store.publication_status(F.col("published_at"), F.col("seen_at")))
    keys = ["event_id", "kol_key", "source", "source_url", "seen_at"]
    return marked.withWatermark("seen_at", "1 hour").dropDuplicatesWithinWatermark(keys)


def _merge_batch(batch: DataFrame, batch_id: int, out: str, quarantine: str) -> None:
    """Writes the batch's merged sightings and what is set aside under its own number: a repeated batch replaces itself."""
    batch.where("time_status <> 'verified'").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
    store.merge_sightings(batch.where("time_status = 'verified'")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def run(spark: SparkSession, landing: str, out: str, quarantine: str, name: str = "observations") -> StreamingQuery:
    """Starts over what has landed and ends when it is merged; the checkpoint under the shared folder makes the next run go on from there."""
    stream = observations(spark, landing).writeStream.foreachBatch(lambda df, k: _merge_batch(df, k, out, quarantine))
    return stream.option("checkpointLocation", f"{shared_dir(spark).rstrip('/')}/{name}-stream").trigger(availableNow=True).start()


def merged(spark: SparkSession, out: str) -> DataFrame:
    """All batches as one table of sightings."""
    parts = spark.read.parquet(out)
    keys = ["event_id", "kol_key", "source", "source_url"]
    first = F.min_by("published_at", F.struct("first_seen", "published_at"))
    return parts.groupBy(*keys).agg(F.sum("observations").alias("observations"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), first.alias("published_at"))


def slot_counts(events: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Counts in half-hour windows of a stream of events, each once no row can come for it any more."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("slot"), "event_type", "n")
