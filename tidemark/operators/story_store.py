"""The story store: batches of observations joined to the stories that share a key with them, each batch once however often it is run.

A story is a class of observations that share a normal title (or, without letters, a canonical url), a url, or titles of which one begins the other,
also over third ones and over stories stored before. It is named by its first observation. Everything a story keeps is the greatest, least or sum of
something, so it doesn't depend on how the observations were dealt into batches, nor on their order within one:

* the longest title (one with content of its own before others, of equal ones the first), as it is shown;
* the longest snippet likewise; the strongest impact; the tickers of the first that has any; the market mark of any;
* the first observation's url, source and person; the publication of the best status, of these the first; the first and last sight, and the number of observations.

The store is a folder with a part for each batch: `stories`, the rows that the batch made or changed (of the parts up to a batch the last row of a story is its state;
a row with merged_into says that the story lives on in another), and `keys`, which key belongs to which story. A batch reads the parts before its own and replaces its own part, so that running it again changes nothing.
Only keys and titles that meet the batch's are read into the joins; links are joined by operators.components, so no key, url or common beginning is held by one task.

Defined cases: rows without a url or title are passed over; repeated rows count as observations; null snippets, tickers and times are none; an empty batch writes empty parts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import states, titles
from ..functions.urls import canonical_url
from ..sources.scratch import shared_dir, stored
from .components import components
from .stories import twins
from .store import publication_status

#: What an observation has.
OBSERVED = "item_id bigint, title string, snippet string, source string, url string, kol_key string, impact string, has_market_kw boolean, tickers string, published_at timestamp, seen_at timestamp"
LEVELS = ("low", "medium", "high")
_TITLE = "struct<eligible: boolean, size: int, first: bigint, title: string>"
_STATE = (
    f"event_id bigint, batch bigint, merged_into bigint, title {_TITLE}, snippet {_TITLE}, impact int, has_market_kw boolean, tickers struct<first: bigint, tickers: string>, "
    "origin struct<first: bigint, url: string, canonical: string, source: string, kol_key: string>, publication struct<rank: int, first: bigint, at: timestamp>, first_seen timestamp, last_seen timestamp, observations bigint"
)
_KEYS = "key string, plain string, event_id bigint, batch bigint"
#: Marks of a title that was cut short. A fixed value.
ELLIPSIS = r"(?:\s*(?:\.{3}|…|\u2026))+\s*$"
_STATUSES = ("verified", "future", "unknown")


def display_title(title: Column) -> Column:
    """White space single, and without a repetition, cut short, of the title in its second half."""
    flat = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " ")), "^ | $", "")
    bare = F.regexp_replace(flat, ELLIPSIS, "")

    def cut(t: Column, whole: Column) -> Column:
        n = F.length(t)
        places = F.filter(F.sequence(F.floor((n + 1) / 2), n - titles.REPEAT), lambda k: t.startswith(F.substr(t, (k + 1).cast("int"))))
        # Few titles begin anew in their second half.
        again = F.contains(F.substr(t, F.floor((n + 1) / 2).cast("int") + 1), F.left(t, F.lit(titles.REPEAT)))
        return F.when((n >= 2 * titles.REPEAT) & again, F.coalesce(F.trim(F.substr(t, F.lit(1), F.get(places, 0).cast("int"))), whole)).otherwise(whole)

    return F.get(F.transform(F.arrays_zip(F.array(bare).alias("t"), F.array(flat).alias("w")), lambda x: cut(x["t"], x["w"])), 0)


def _level(impact: Column) -> Column:
    return F.when(impact == "high", 2).when(impact == "medium", 1).otherwise(0)


def observed(items: DataFrame, by_shown: bool = True) -> DataFrame:
    """Observations as stories of one, with the keys that they may share: their state and key, url_key, plain (the normal title).

    The normal title is that of the title as it is shown or else as it came; they differ where what is shown repeats itself once more.
    """
    rows = items.withColumns({"_url": F.trim(F.coalesce("url", F.lit(""))), "_title": F.trim(F.coalesce("title", F.lit("")))}).where("_url <> '' AND _title <> ''")
    rows = rows.withColumns({"_came": F.col("_title"), "_title": display_title(F.col("_title")), "_canonical": canonical_url(F.col("_url")), "_snippet": F.trim(F.coalesce("snippet", F.lit("")))})
    rows = rows.withColumn("_plain", titles.normal_title(F.col("_title" if by_shown else "_came"))).withColumn("_able", states.content_eligible(F.col("source"), F.coalesce("_canonical", "_url"), F.col("_snippet"), F.col("_title")))
    status = publication_status(F.col("published_at"), F.col("seen_at"))
    rank = F.when(status == "verified", 0).when(status == "future", 1).otherwise(2)
    best = lambda text: F.struct(F.col("_able").alias("eligible"), F.length(text).alias("size"), (-F.col("item_id")).alias("first"), F.col(text).alias("title"))
    first = F.col("item_id").alias("first")
    return rows.select(
        F.col("item_id").alias("event_id"), best("_title").alias("title"), best("_snippet").alias("snippet"), _level(F.col("impact")).alias("impact"), F.coalesce("has_market_kw", F.lit(False)).alias("has_market_kw"),
        F.when(F.col("tickers") != "", F.struct(first, "tickers")).alias("tickers"), F.struct(first, F.col("_url").alias("url"), F.col("_canonical").alias("canonical"), "source", "kol_key").alias("origin"),
        F.struct(rank.alias("rank"), first, F.when(rank < 2, F.col("published_at")).alias("at")).alias("publication"), F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"), F.lit(1).cast("bigint").alias("observations"),
        F.concat(F.lit("d:"), titles.title_digest(F.col("_plain"), F.col("_url"))).alias("key"), F.concat(F.lit("u:"), F.left(F.sha1(F.coalesce("_canonical", "_url")), F.lit(16))).alias("url_key"), F.when(F.length("_plain") >= titles.LEAST, F.col("_plain")).alias("plain"),
    )


def _together() -> list[Column]:
    """The aggregates that make one story of several."""
    return [
        F.max("title").alias("title"), F.max("snippet").alias("snippet"), F.max("impact").alias("impact"), F.max("has_market_kw").alias("has_market_kw"), F.min("tickers").alias("tickers"), F.min("origin").alias("origin"),
        F.min("publication").alias("publication"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("observations").alias("observations"),
    ]


def _node(event: Column) -> Column:
    return F.lpad(event.cast("string"), 20, "0")


def _links(fresh: DataFrame, keys: DataFrame) -> DataFrame:
    """Links of stories (numbers) and keys: those of the batch, and of what is stored under the same keys or twin titles."""
    own = fresh.select(_node(F.col("event_id")).alias("u"), "key").withColumnRenamed("key", "v").unionAll(fresh.select(_node(F.col("event_id")), "url_key"))
    begin = F.xxhash64(F.left("plain", F.lit(titles.LEAST)))
    begun = fresh.where("plain IS NOT NULL").select(begin.alias("begin")).distinct()
    # Stored titles with a beginning that the batch has too, and the batch's own.
    near = keys.where("plain IS NOT NULL").withColumn("begin", begin).join(begun, "begin", "left_semi").select("key", "plain")
    named = near.unionAll(fresh.where("plain IS NOT NULL").select("key", "plain")).distinct()
    pairs = twins(named.select("plain").distinct())
    paired = pairs.join(named.select(F.col("key").alias("u"), F.col("plain").alias("long")), "long").join(named.select(F.col("key").alias("v"), F.col("plain").alias("short")), "short").select("u", "v")
    asked = own.select(F.col("v").alias("key")).unionAll(paired.select("u")).unionAll(paired.select("v")).distinct()
    known = keys.join(asked, "key", "left_semi").select(_node(F.col("event_id")).alias("u"), F.col("key").alias("v"))
    return own.unionAll(paired).unionAll(known).distinct()


def state(spark: SparkSession, store: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(stories, keys) of the store as they are after the parts with numbers below `before`, all if None; merged stories are not among them."""
    until = F.lit(True) if before is None else F.col("batch") < before

    def part(name: str, schema: str, key: str) -> DataFrame:
        try:
            rows = spark.read.schema(schema).parquet(f"{store.rstrip('/')}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], schema)
        columns = [c for c in rows.columns if c != key]
        return rows.where(until).groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_s")).select(key, *[F.col(f"_s.{c}").alias(c) for c in columns])

    return part("stories", _STATE, "event_id").where("merged_into IS NULL"), part("keys", _KEYS, "key")


def upsert(items: DataFrame, store: str, batch: int, by_shown: bool = True) -> None:
    """Join a batch of observations (OBSERVED) to the store at a folder; a repeated batch replaces its part. All batches of a store name their keys in one way (see observed)."""
    spark = items.sparkSession
    stories, keys = state(spark, store, batch)
    fresh = stored(observed(items, by_shown), "observed")
    roots = components(_links(fresh, keys)).select("node", F.col("root").cast("bigint").alias("root"))
    roots = stored(roots, "story-roots")
    numbers = roots.where(~F.col("node").rlike("^[a-z]:")).select(F.col("node").cast("bigint").alias("event_id"), "root")
    met = stories.join(numbers, "event_id").drop("batch", "merged_into")
    made = fresh.drop("key", "url_key", "plain").join(numbers, "event_id", "left").withColumn("root", F.coalesce("root", "event_id"))
    whole = met.unionByName(made).groupBy(F.col("root").alias("event_id")).agg(*_together()).withColumn("merged_into", F.lit(None).cast("bigint"))
    gone = met.where("event_id <> root").withColumn("merged_into", F.col("root")).select(*whole.columns)
    whole.unionByName(gone).write.mode("overwrite").parquet(f"{store.rstrip('/')}/stories/batch={batch}")
    new = fresh.select("key", "plain", "event_id").unionAll(fresh.select("url_key", F.lit(None).cast("string"), "event_id")).groupBy("key").agg(F.max("plain").alias("plain"), F.min("event_id").alias("event_id"))
    # Keys of the batch, and those of stories that live on in others.
    moved = keys.join(met.where("event_id <> root").select("event_id", "root"), "event_id").select("key", "plain", F.col("root").alias("event_id"))
    owned = new.join(numbers, "event_id", "left").select("key", "plain", F.coalesce("root", "event_id").alias("event_id")).unionAll(moved)
    owned.groupBy("key").agg(F.max("plain").alias("plain"), F.min("event_id").alias("event_id")).write.mode("overwrite").parquet(f"{store.rstrip('/')}/keys/batch={batch}")


def stories(spark: SparkSession, store: str) -> DataFrame:
    """The stories of a store with plain columns."""
    rows, _ = state(spark, store)
    rank = F.col("publication.rank")
    return rows.select(
        "event_id", F.col("title.title").alias("title"), F.col("snippet.title").alias("snippet"), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("impact") + 1).alias("impact"), "has_market_kw", F.col("tickers.tickers").alias("tickers"),
        "origin.url", F.col("origin.canonical").alias("canonical_url"), "origin.source", "origin.kol_key", F.col("publication.at").alias("published_at"), F.element_at(F.array(*map(F.lit, _STATUSES)), rank + 1).alias("published_status"),
        "first_seen", "last_seen", "observations",
    )


def run(spark: SparkSession, landing: str, store: str, name: str = "stories", most_files: int = 1) -> StreamingQuery:
    """Joins what has landed (Parquet files of OBSERVED) to the store, batch by batch, and ends; the next run goes on from there."""
    stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", most_files).parquet(landing).writeStream.foreachBatch(lambda rows, k: upsert(rows, store, k))
    return stream.option("checkpointLocation", f"{shared_dir(spark).rstrip('/')}/{name}-stream").trigger(availableNow=True).start()
