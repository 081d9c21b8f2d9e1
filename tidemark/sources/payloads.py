"""Payloads of providers, a row each, to rows of data: chart JSON, quotes, CSV, WebVTT, RSS, holdings."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHART = "chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<bigint>, indicators: struct<quote: array<struct<close: array<double>, volume: array<bigint>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"
MOST_ITEMS, MOST_BYTES = 300, 2 << 20


def chart_bars(payloads: DataFrame) -> DataFrame:
    """payloads(source, body: chart JSON) -> (source, symbol, ts, close, volume): arrays zipped, the adjusted close preferred, points without a positive close dropped."""
    r = payloads.select("source", F.explode(F.from_json("body", _CHART)["chart"]["result"]).alias("r"))
    quote, adjusted = F.get(F.col("r.indicators.quote"), 0), F.get(F.col("r.indicators.adjclose"), 0)
    zipped = F.arrays_zip(F.col("r.timestamp").alias("t"), quote["close"].alias("c"), quote["volume"].alias("v"), F.coalesce(adjusted["adjclose"], F.array().cast("array<double>")).alias("a"))
    rows = r.select("source", F.col("r.meta.symbol").alias("symbol"), F.explode(zipped).alias("z"))
    close = F.coalesce("z.a", "z.c")
    return rows.select("source", "symbol", F.timestamp_seconds("z.t").alias("ts"), close.alias("close"), F.col("z.v").alias("volume")).where((F.col("close") > 0) & F.col("ts").isNotNull())


def quotes(payloads: DataFrame) -> DataFrame:
    """payloads(symbol, body: `v_SYMBOL="a~b~..."`) -> (symbol, name, price, previous); rows whose body is another symbol's, or has no price, go."""
    inner = F.regexp_extract("body", '^v_([A-Za-z0-9]+)="([^"]*)"', 2)
    parts = F.split(inner, "~")
    number = lambda k: F.get(parts, k).try_cast("double")
    rows = payloads.where(F.regexp_extract("body", "^v_([A-Za-z0-9]+)=", 1) == F.col("symbol"))
    return rows.select("symbol", F.get(parts, 1).alias("name"), number(3).alias("price"), number(4).alias("previous")).where(F.col("price") > 0)


def last_complete(rows: DataFrame, order: str, values: list[str]) -> DataFrame:
    """The last row in order of which no value is missing."""
    whole = rows.where(" AND ".join(f"`{v}` IS NOT NULL" for v in values))
    return whole.agg(F.max(F.struct(order, *values)).alias("r")).select("r.*")


def series_csv(lines: DataFrame) -> DataFrame:
    """lines(series, line: `date,value`) -> (series, day, value), dates in four forms, headers and lines without a number dropped. A day given twice is an error."""
    parts = F.split("line", ",")
    text = F.trim(F.get(parts, 0))
    day = F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyyMMdd")])
    rows = lines.select("series", day.alias("day"), F.trim(F.get(parts, 1)).try_cast("double").alias("value")).where("day IS NOT NULL AND value IS NOT NULL")
    checked = rows.groupBy("series", "day").agg(F.count("*").alias("n"), F.first("value").alias("value"))
    return checked.select("series", "day", F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("twice"), "series", "day")).cast("double")).alias("value"))


def clock(text: Column) -> Column:
    """Seconds of hh:mm:ss.mmm or mm:ss.mmm."""
    return F.aggregate(F.split(text, ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double"))


def webvtt(files: DataFrame) -> DataFrame:
    """files(doc, body) -> (doc, at, start, end, speaker, text): the cues of WebVTT, speakers from voice tags."""
    blocks = files.select("doc", F.posexplode(F.split(F.regexp_replace("body", "\r", ""), "\n[ \t]*\n")).alias("at", "block"))
    cues = blocks.where(F.col("block").contains("-->"))
    time = r"([0-9:]+\.[0-9]{3}) --> ([0-9:]+\.[0-9]{3})[^\n]*\n"
    text = F.regexp_extract("block", time + r"([\s\S]*)$", 3)
    return cues.select(
        "doc", "at", clock(F.regexp_extract("block", time, 1)).alias("start"), clock(F.regexp_extract("block", time, 2)).alias("end"), F.nullif(F.regexp_extract(text, "^<v ([^>]*)>", 1), F.lit("")).alias("speaker"),
        F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"\s+", " ")).alias("text"),
    )


def ranked_lists(lists: DataFrame, most: int = 40) -> DataFrame:
    """lists(name: top or best, ids: array) -> (id, rank, top_rank, best_rank): the place in each list, the lesser of both."""
    places = lists.select("name", F.posexplode(F.slice("ids", 1, most)).alias("p", "id"))
    one = lambda name: F.min(F.when(F.col("name") == name, F.col("p") + 1))
    both = places.groupBy("id").agg(one("top").alias("top_rank"), one("best").alias("best_rank"))
    return both.select("id", F.least("top_rank", "best_rank").alias("rank"), "top_rank", "best_rank")


def _items(body: str | None) -> list[tuple[str, str, str, str]]:
    """(title, url, published, summary) of the items of RSS, RDF or Atom; none if it isn't safe or readable XML."""
    if not body or len(body) > MOST_BYTES or "<!DOCTYPE" in body or "<!ENTITY" in body:
        return []
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return []
    out, seen = [], set()
    for node in root.iter():
        if node.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        fields = {child.tag.rpartition("}")[2]: child for child in reversed(list(node))}
        text = lambda *names: next(("".join(fields[n].itertext()).strip() for n in names if n in fields), "")  # noqa: B023, E731
        url = text("link") or (fields["link"].get("href", "") if "link" in fields else "")
        title = text("title")
        if title and url and url not in seen:
            seen.add(url)
            out.append((title, url, text("pubDate", "published", "updated", "date"), text("description", "summary")))
    return out[:MOST_ITEMS]


def feed_items(payloads: DataFrame) -> DataFrame:
    """payloads(source, body: RSS or Atom) -> (source, at, title, url, published, summary), a URL once in a feed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, k, *item) for s, body in zip(batch["source"], batch["body"], strict=True) for k, item in enumerate(_items(body))]
            yield pd.DataFrame(rows, columns=["source", "at", "title", "url", "published", "summary"])

    return payloads.select("source", "body").mapInPandas(run, "source string, at int, title string, url string, published string, summary string")


def feed_time(text: Column) -> Column:
    """The instant of RFC 2822 or ISO text with an offset; null for one without, which is never taken for UTC."""
    forms = ("EEE, d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z")
    named = F.regexp_replace(F.trim(text), " (GMT|UTC|UT|Z)$", " +0000")
    iso = F.when(F.trim(text).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T.*(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.trim(text).try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(F.regexp_replace(named, "^[A-Za-z]{3}, ", ""), F.lit(f)) for f in forms[1:]])


def holdings(lines: DataFrame) -> DataFrame:
    """lines(doc, at, line) of Markdown -> (doc, at, asset, quantity): rows of tables whose second cell is a number, outside header and rule lines."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    quantity = F.regexp_replace(F.get(cells, 1), ",", "").try_cast("decimal(18,4)")
    rows = lines.where(F.trim("line").startswith("|"))
    return rows.select("doc", "at", F.upper(F.get(cells, 0)).alias("asset"), quantity.alias("quantity")).where("quantity IS NOT NULL AND asset <> ''")


#: Tenors of the yield curve and the elements that hold them. Fixed values.
TENORS = {"2Y": "BC_2YEAR", "10Y": "BC_10YEAR", "30Y": "BC_30YEAR"}


def treasury_yields(payloads: DataFrame) -> DataFrame:
    """payloads(source, body: the Atom feed of daily curves) -> (source, as_of, yields: tenor to value or null, status).

    Of each tenor, and of the day, the last value in the document counts, so a day without one leaves the earlier one standing. A document without any value, or null, is
    `unavailable`, one with some of them `partial`, else `ready`; none is dropped.
    """
    last = lambda pattern: F.element_at(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(pattern), 1), -1)
    held = lambda pattern: F.regexp_like(F.coalesce("body", F.lit("")), F.lit(pattern))
    value = lambda tag: F.when(held(rf"<d:{tag}[^>]*>[0-9.]+</d:{tag}>"), F.round(last(rf"<d:{tag}[^>]*>([0-9.]+)</d:{tag}>").try_cast("double"), 3))
    day = F.when(held("<d:NEW_DATE[^>]*>[0-9-]+T"), last("<d:NEW_DATE[^>]*>([0-9-]+)T"))
    rows = payloads.select("source", day.alias("as_of"), F.create_map(*[x for name, tag in TENORS.items() for x in (F.lit(name), value(tag))]).alias("yields"))
    known = F.size(F.array_compact(F.map_values("yields")))
    return rows.withColumn("status", F.when(known == 0, "unavailable").when(known < len(TENORS), "partial").otherwise("ready"))
