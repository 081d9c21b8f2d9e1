"""Queues and quotas: rolling counts, claims, retries, interleaving, abandoned calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Seconds of the spans of time that rows are dealt by; a span's rows of one key are ordered in one task.
CHUNK = 3600


def _second(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def _chunk(second: Column) -> Column:
    return F.floor(second / CHUNK)


def rolling_counts(requests: DataFrame, key: str, ts: str, seconds: dict[str, int]) -> DataFrame:
    """Adds, for each name, how many requests of the key came in the seconds up to and with this one.

    A count is the difference of two running counts, of this second and of the last one before the span. Running counts are kept by second within
    a key's chunk and added to the sum of the chunks before, so no row meets the others of its span and no key is ordered as a whole. Requests without a time count one another.
    """
    at = requests.withColumn("_s", _second(ts))
    counts = at.groupBy(F.col(key).alias("_key"), "_s").agg(F.count("*").alias("_n"))
    asks = [F.struct(F.lit(None).cast("string").alias("name"), F.col("_s").alias("t"), F.col("_n").alias("n"))]
    asks += [F.struct(F.lit(name).alias("name"), (F.col("_s") - span - 1).alias("t"), F.lit(0).cast("bigint").alias("n")) for name, span in seconds.items()]
    points = counts.select("_key", "_s", F.explode(F.array(*asks)).alias("a")).where("a.name IS NULL OR _s IS NOT NULL").select("_key", "_s", "a.*").withColumn("chunk", _chunk(F.col("t")))
    sums = points.groupBy("_key", "chunk").agg(F.sum("n").alias("n"))
    before = sums.select("_key", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = points.withColumn("within", F.sum("n").over(Window.partitionBy("_key", "chunk").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)))
    b = before.select(F.col("_key").alias("_k"), F.col("chunk").alias("_c"), "before")
    ran = within.join(b, F.col("_key").eqNullSafe(F.col("_k")) & F.col("chunk").eqNullSafe(F.col("_c"))).withColumn("upto", F.col("within") + F.col("before"))
    own = F.max(F.when(F.col("name").isNull(), F.col("upto")))
    found = ran.groupBy("_key", "_s").agg(*[(own - F.coalesce(F.max(F.when(F.col("name") == name, F.col("upto"))), F.lit(0))).alias(name) for name in seconds])
    found = found.withColumnsRenamed({"_key": "_k", "_s": "_t"})
    return at.join(found, F.col(key).eqNullSafe(F.col("_k")) & F.col("_s").eqNullSafe(F.col("_t"))).select(*requests.columns, *seconds)


def gaps(requests: DataFrame, key: str, ts: str, order: str, name: str = "gap") -> DataFrame:
    """Adds the seconds since the request of the key before this one, by time and then order; null for the first.

    Within a chunk that is the row before; the first row of a chunk asks for the last second of the key's chunk before.
    """
    at = requests.withColumn("_s", _second(ts)).withColumn("_chunk", _chunk(F.col("_s")))
    last = at.groupBy(F.col(key).alias("_k"), F.col("_chunk").alias("_c")).agg(F.max("_s").alias("_end"))
    last = last.select("_k", "_c", F.lag("_end").over(Window.partitionBy("_k").orderBy("_c")).alias("_end"))
    near = at.withColumn("_n", F.row_number().over(w := Window.partitionBy(key, "_chunk").orderBy(ts, order))).withColumn("_before", F.lag("_s").over(w))
    met = near.join(last, F.col(key).eqNullSafe(F.col("_k")) & F.col("_chunk").eqNullSafe(F.col("_c")))
    return met.select(*requests.columns, (F.col("_s") - F.when(F.col("_n") == 1, F.col("_end")).otherwise(F.col("_before"))).alias(name))


def quota_verdict(gap: Column, hour: Column, day: Column, cooldown: int = 10, most_hour: int = 20, most_day: int = 50) -> Column:
    """The first limit that a request breaks, in order, or accepted."""
    return F.when(gap < cooldown, "cooldown").when(hour > most_hour, "hour_limit").when(day > most_day, "day_limit").otherwise("accepted")


def interleave(tasks: DataFrame, kind: str, order: list[Column]) -> DataFrame:
    """Adds place: the tasks of each kind in order, taken in turn (the kinds by name)."""
    return tasks.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(*order)))


def claimable(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks to claim: pending, failed with their retry time come, or running with their lease over."""
    ready = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("retry_at") <= now)) | ((F.col("status") == "running") & (F.col("lease_until") < now))
    return tasks.where(ready)


def supersede(jobs: DataFrame) -> DataFrame:
    """Jobs(job_id, article, version, state): of an article's queued jobs only that of the newest version stays queued."""
    newest = F.max(F.when(F.col("state") == "queued", F.struct("version", "job_id"))).over(Window.partitionBy("article"))
    old = (F.col("state") == "queued") & (F.struct("version", "job_id") < newest)
    return jobs.withColumn("state", F.when(old, "superseded").otherwise(F.col("state")))


def abandon(calls: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Started calls without an end after so many seconds are failed."""
    late = (F.col("status") == "started") & (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")) > seconds)
    return calls.withColumn("status", F.when(late, "abandoned").otherwise(F.col("status")))


def usage(calls: DataFrame) -> DataFrame:
    """Counts and tokens of calls; the average time only of those that have one."""
    return calls.agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"),
        F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"), F.avg("seconds").alias("mean_seconds"),
    )


def select_due(work: DataFrame, k: int) -> DataFrame:
    """Work(edge_id, due_at, retry) -> at most k: a third of them, one at least, for retries; then others; then what is left, by due time.

    Two ordered limits, so the driver gets no more than k rows of either kind.
    """
    reserve = max(1, round(0.33 * k))
    place = F.row_number().over(Window.partitionBy("retry").orderBy("due_at", "edge_id"))
    ranked = work.withColumn("_n", place).where(F.col("_n") <= k)
    tier = F.when(F.col("retry") & (F.col("_n") <= reserve), 0).when(~F.col("retry"), 1).otherwise(2)
    return ranked.withColumn("tier", tier).orderBy("tier", "due_at", "edge_id").limit(k).drop("_n")
