"""Strict import of daily snapshots: a file is taken whole or not at all, and so is a batch of files.

Every rule is a column; the first that a file breaks is its reason. Keys given twice, which a JSON reader would pass over, are found by a walk over the text.
A batch is written aside with its verdict observed on the way; only a batch without a broken rule gets its name into the list of those that count, so a reader never
sees half of one, and a batch that is run again replaces itself.

Defined cases: a null or empty file is unreadable; null fields count as missing; an empty batch is accepted and has no items; repeated file names are files of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.json_walk import duplicate_key

#: The snapshots' form. Fixed values.
VERSION = 1
FIELDS = ("schema_version", "snapshot_date", "generated_at", "source_as_of", "sections")
SECTIONS = ("macro", "world", "finance", "technology", "ai", "investors")
TIERS = ("official", "first_party", "media", "discovery")
ITEM_FIELDS = ("title", "source", "source_url", "source_tier", "published_at", "fetched_at", "disclosed_at", "effective_at", "period_end", "data_as_of", "summary", "why", "why_it_matters", "assets", "cross_tags")
MOST_BYTES, MOST_IN_SECTION, MOST_ITEMS, MOST_TITLE, MOST_URL, MOST_SOURCE, SKEW = 2 * 1024 * 1024, 80, 300, 300, 2048, 120, 300
ZONE = "Asia/Shanghai"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})$"


def instant(text: Column) -> Column:
    """The instant of ISO text with an offset, else null."""
    return F.when(text.rlike(_TIME), text.try_cast("timestamp"))


def _seconds(at: Column) -> Column:
    return F.unix_seconds(at.cast("timestamp"))


def _after(a: Column, b: Column, skew: int = SKEW) -> Column:
    return F.coalesce(_seconds(a) > _seconds(b) + skew, F.lit(False))


def _names(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ", ")


def _texts(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def parsed(files: DataFrame) -> DataFrame:
    """files(file, body) with what the rules ask of each: keys, fields, sections."""
    field = lambda name: F.get_json_object("body", f"$.{name}").alias(name)
    sections = F.get_json_object("body", "$.sections")
    rows = files.select(
        "file", "body", duplicate_key(F.col("body")).alias("twice"), F.json_object_keys("body").alias("keys"), *[field(c) for c in FIELDS[:4]], F.json_object_keys(sections).alias("names"),
        F.from_json(sections, "map<string, array<map<string, string>>>").alias("items"),
    )
    return rows.withColumns({"generated": instant(F.col("generated_at")), "as_of": instant(F.col("source_as_of")), "day": F.col("snapshot_date").try_cast("date")})


def _file_reason(now: Column) -> Column:
    extra, lacking = F.array_except("keys", _texts(FIELDS)), F.array_except(_texts(FIELDS), F.col("keys"))
    more, fewer = F.array_except("names", _texts(SECTIONS)), F.array_except(_texts(SECTIONS), F.col("names"))
    local = F.to_date(F.from_utc_timestamp(F.to_utc_timestamp("generated", F.current_timezone()), ZONE))
    crowded = F.filter(_texts(SECTIONS), lambda s: F.size(F.element_at("items", s)) > MOST_IN_SECTION)
    total = F.aggregate(F.map_values("items"), F.lit(0), lambda n, x: n + F.greatest(F.size(x), F.lit(0)))
    rules = [
        (F.octet_length(F.coalesce("body", F.lit(""))) > MOST_BYTES, F.lit("briefing file exceeds the supported size")),
        (F.coalesce(F.col("twice") == " ", F.col("body").isNull()) | F.col("keys").isNull(), F.lit("payload must be an object")),
        (F.col("twice").isNotNull(), F.concat(F.lit("duplicate JSON key: "), "twice")),
        (F.size(extra) > 0, F.concat(F.lit("payload contains unsupported fields: "), _names(extra))),
        (F.size(lacking) > 0, F.concat(F.lit("payload is missing required fields: "), _names(lacking))),
        (~F.coalesce(F.col("schema_version") == str(VERSION), F.lit(False)), F.lit(f"schema_version must be {VERSION}")),
        (F.col("day").isNull() | (F.date_format("day", "yyyy-MM-dd") != F.col("snapshot_date")), F.lit("snapshot_date must be an ISO-8601 date")),
        (F.col("generated").isNull() | _after(F.col("generated"), now), F.lit("generated_at must be a time with an offset, not in the future")),
        (F.col("as_of").isNull() | _after(F.col("as_of"), now), F.lit("source_as_of must be a time with an offset, not in the future")),
        (F.col("day") != local, F.lit("snapshot_date must match generated_at in Asia/Shanghai")),
        (_after(F.col("as_of"), F.col("generated")), F.lit("source_as_of cannot be after generated_at")),
        (F.col("names").isNull() | F.col("items").isNull(), F.lit("sections must be an object")),
        ((F.size(more) > 0) | (F.size(fewer) > 0), F.concat(F.lit("invalid sections ("), F.concat_ws("; ", F.when(F.size(more) > 0, F.concat(F.lit("unknown: "), _names(more))), F.when(F.size(fewer) > 0, F.concat(F.lit("missing: "), _names(fewer)))), F.lit(")"))),
        (F.size(crowded) > 0, F.concat(F.lit("sections."), F.get(crowded, 0), F.lit(" contains too many items"))),
        (total > MOST_ITEMS, F.lit("payload contains too many items")),
    ]
    return F.coalesce(*[F.when(broken, reason) for broken, reason in rules])


def _item_reason(item: Column, place: Column, as_of: Column, now: Column) -> Column:
    value = lambda name: F.element_at(item, name)
    at = lambda name: instant(value(name))
    unknown = F.array_except(F.map_keys(item), _texts(ITEM_FIELDS))
    said = lambda text: F.concat(place, F.lit(text))
    bad_text = lambda name, most: (F.trim(F.coalesce(value(name), F.lit(""))) == "") | (F.length(value(name)) > most)
    bad_time = lambda name: value(name).isNotNull() & (at(name).isNull() | _after(at(name), now))
    late = F.array_compact(F.array(*[F.when(_after(at(c), as_of, 0 if c == "fetched_at" else SKEW), F.lit(c)) for c in ("published_at", "fetched_at", "disclosed_at")]))
    host = F.regexp_extract(value("source_url"), r"^https?://([^/?#@:\s\\]+\.[^/?#@:\s\\]+)(?:[/?#]|$)", 1)
    rules = [
        (item.isNull(), said(" must be an object")),
        (F.size(unknown) > 0, F.concat(place, F.lit(" contains unsupported fields: "), _names(unknown))),
        (bad_text("title", MOST_TITLE), said(".title must be a text of bounded length")),
        (bad_text("source_url", MOST_URL) | (host == "") | F.lower(host).rlike(r"(^|\.)localhost$|\.local$|^[0-9.]+$"), said(".source_url must be a public http url")),
        (F.length(F.coalesce(value("source"), F.lit(""))) > MOST_SOURCE, said(".source must be a text of bounded length")),
        (~F.coalesce(value("source_tier").isin(*TIERS), F.lit(False)), said(f".source_tier must be one of {', '.join(TIERS)}")),
        *[(bad_time(c), said(f".{c} must be a time with an offset, not in the future")) for c in ("published_at", "fetched_at", "disclosed_at")],
        (value("published_at").isNull() & value("fetched_at").isNull(), said(" requires published_at or fetched_at")),
        (F.size(F.array_distinct(F.array_compact(F.array(value("effective_at"), value("period_end"), value("data_as_of"))))) > 1, said(" contains conflicting effective_at, period_end or data_as_of values")),
        (F.coalesce(value("why") != value("why_it_matters"), F.lit(False)), said(" cannot provide conflicting why and why_it_matters values")),
        (~F.coalesce(value("title").rlike(r"[\p{L}\p{N}]"), F.lit(False)), said(".title has no searchable content")),
        (F.size(late) > 0, F.concat(F.lit("item "), F.get(late, 0), F.lit(" cannot be after source_as_of"))),
    ]
    return F.coalesce(*[F.when(broken, reason) for broken, reason in rules])


def checked(files: DataFrame, now: Column) -> DataFrame:
    """files(file, body) -> (file, reason, snapshot_date, generated, as_of, items): reason is null for a file that may come in.

    Items are judged where they lie: sections in their order, and in each by place; the first broken rule is the file's reason.
    """
    rows = parsed(files).withColumn("_reason", _file_reason(now))
    of_section = lambda s: F.transform(F.coalesce(F.element_at("items", s), F.array().cast("array<map<string,string>>")), lambda x, i: _item_reason(x, F.concat(F.lit("sections."), s, F.lit("["), i.cast("string"), F.lit("]")), F.col("as_of"), now))
    of_items = F.get(F.array_compact(F.flatten(F.transform(_texts(SECTIONS), of_section))), 0)
    return rows.select("file", F.coalesce("_reason", F.when(F.col("_reason").isNull(), of_items)).alias("reason"), "snapshot_date", "generated", "as_of", "items")


def items_of(rows: DataFrame) -> DataFrame:
    """(file, snapshot_date, section, place, title, source, source_url, source_tier, published_at, fetched_at, time_status) of accepted files."""
    spread = rows.where("reason IS NULL").select("file", "snapshot_date", F.explode("items").alias("section", "list")).select("file", "snapshot_date", "section", F.posexplode("list").alias("place", "i"))
    value = lambda name: F.element_at("i", name)
    status = F.when(value("published_at").isNotNull(), "verified").otherwise("fetched_only")
    return spread.select("file", "snapshot_date", "section", "place", *[value(c).alias(c) for c in ("title", "source", "source_url", "source_tier")], instant(value("published_at")).alias("published_at"), instant(value("fetched_at")).alias("fetched_at"), status.alias("time_status"))


@dataclass
class Verdict:
    """What became of a batch: its files, those that broke a rule, the first of these by name with its reason."""

    files: int
    broken: int
    file: str | None
    reason: str | None


def import_batch(files: DataFrame, store: str, batch: int, now: Column) -> Verdict:
    """Write a batch aside and, if every file of it may come in, name it among those that count."""
    seen = Observation(f"batch-{batch}")
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("file", "reason")))
    rows = checked(files, now).observe(seen, F.count("*").alias("files"), F.count("reason").alias("broken"), first["file"].alias("file"), first["reason"].alias("reason"))
    rows.write.mode("overwrite").parquet(f"{store.rstrip('/')}/files/batch={batch}")
    told = Verdict(**seen.get)
    named = files.sparkSession.range(1 if not told.broken else 0).select(F.lit(told.files).cast("bigint").alias("files"))
    named.coalesce(1).write.mode("overwrite").parquet(f"{store.rstrip('/')}/accepted/batch={batch}")
    return told


def accepted(spark: SparkSession, store: str) -> DataFrame:
    """The items of all batches that count."""
    named = spark.read.schema("files bigint, batch bigint").parquet(f"{store.rstrip('/')}/accepted").select("batch").distinct()
    kind = "file string, reason string, snapshot_date string, generated timestamp, as_of timestamp, items map<string, array<map<string, string>>>, batch bigint"
    return items_of(spark.read.schema(kind).parquet(f"{store.rstrip('/')}/files").join(F.broadcast(named), "batch"))
