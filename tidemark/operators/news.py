"""News and feeds: snapshots, catalogues, coverage, anchors in time, overlays, generators of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, signals


def snapshot(items: DataFrame, bridge: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """items(item_id, published, first_seen, ...) of the last days with their sorted sources; a time unknown is the first seen."""
    recent = items.withColumn("shown_at", F.coalesce("published", "first_seen")).where((F.col("shown_at") >= now - F.make_interval(days=F.lit(days))) & (F.col("shown_at") <= now))
    sources = bridge.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("source").alias("n_sources"))
    return recent.join(sources, "item_id")


def catalogue(instruments: DataFrame, items: DataFrame) -> DataFrame:
    """(instrument) with its direct and related items; those without any stay with zeros."""
    one = lambda kind: F.count_if(F.col("kind") == kind)
    counts = items.groupBy("instrument").agg(one("direct").alias("direct"), one("related").alias("related"))
    return instruments.join(counts, "instrument", "left").select("instrument", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("direct", "related")])


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(available, total, pct): how many of the fields' values are there."""
    available = sum((F.count(f) for f in fields), F.lit(0))
    total = F.count("*") * len(fields)
    return rows.agg(available.alias("available"), total.alias("total"), F.round(100 * available / total, 1).alias("pct"))


def reason_histogram(reactions: DataFrame) -> DataFrame:
    return reactions.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("asset").alias("assets"))


def anchors(points: DataFrame, hours: int = 24) -> DataFrame:
    """points(series, ts, value): the value so many hours before the last point, in two ways: at or before that instant, and nearest to it (the earlier of equals)."""
    last = points.groupBy("series").agg(F.max(F.struct("ts", "value")).alias("l"))
    j = points.join(last, "series").withColumn("target", F.col("l.ts") - F.make_interval(hours=F.lit(hours)))
    gap = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("target").cast("timestamp")))
    others = j.where(F.col("ts") < F.col("l.ts"))
    before = F.max(F.when(F.col("ts") <= F.col("target"), F.struct("ts", "value")))
    found = others.groupBy("series", F.col("l.value").alias("last_value")).agg(before.alias("b"), F.min(F.struct(gap, "ts", "value")).alias("n"))
    return found.select("series", "last_value", F.col("b.value").alias("value_before"), F.col("n.value").alias("value_nearest"))


def window_states(edges: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """(edge_id, event_ts) and stored(edge_id, window, status, retry_hours) -> (edge_id, window, state, due_at): pending before event + n days, else by status."""
    spans = F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("window")
    all_ = edges.select("edge_id", "event_ts", spans).withColumn("due_at", F.col("event_ts") + F.make_interval(days=F.col("window")))
    j = all_.join(stored, ["edge_id", "window"], "left")
    state = F.when(F.col("status") == "complete", "done").when(F.col("due_at") > now, "not_due").when(F.col("status") == "unavailable", "retry").otherwise("due")
    return j.select("edge_id", "window", state.alias("state"), "due_at")


def best_by_window(stored: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """The row of the best rank, then of the last observation, of each key."""
    best = F.max(F.struct(rank.alias("r"), F.col("observed_at"), F.col("row_id"), F.col("status")))
    return stored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.row_id", "b.status")


def merged_feeds(priority: DataFrame, regular: DataFrame, key: str) -> DataFrame:
    """All of the first feed, and what the second has beside it; feed tells which."""
    first = priority.withColumn("feed", F.lit("priority"))
    return first.unionByName(regular.withColumn("feed", F.lit("regular")).join(priority.select(key), key, "left_anti"))


def overlay(cards: DataFrame, positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Cards with the positions in their asset: exposure only where all are of one currency and a price is there; confidence fades by .8 with a stale position, by .75 with a stale quote."""
    held = positions.groupBy("asset").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("positions"), F.count_distinct("currency").alias("currencies"), F.bool_or("stale").alias("position_stale"))
    j = cards.join(held, "asset", "left").join(quotes, "asset", "left")
    fade = F.when(F.coalesce("position_stale", F.lit(False)), 0.8).otherwise(1.0) * F.when(F.coalesce("quote_stale", F.lit(True)), 0.75).otherwise(1.0)
    exposure = F.when((F.col("currencies") == 1) & ~F.coalesce("quote_stale", F.lit(True)), F.col("price") * F.col("quantity"))
    return j.select("card_id", "asset", F.coalesce("positions", F.lit(0)).alias("positions"), F.round(exposure, 2).alias("exposure"), F.round(F.col("confidence") * fade, 4).alias("confidence"))


def event_edges(events: DataFrame) -> DataFrame:
    """events(event_id, text, tickers, impact) -> an edge for each asset, or one without an asset."""
    found = events.withColumns({"assets": signals.assets(F.col("text"), F.col("tickers")), "topic": rules.topic(F.col("text")), "stance": rules.stance(F.col("text"))})
    rows = found.withColumn("asset", F.explode_outer("assets"))
    way = F.when(F.col("stance") == "unknown", "neutral").otherwise(F.col("stance"))
    sure = rules.confidence(F.col("asset").isNotNull(), F.col("stance"), F.col("topic"), F.lit(True))
    return rows.select("event_id", "topic", "asset", way.alias("direction"), sure.alias("confidence"), rules.strength(F.col("impact"), way, F.lit(True)).alias("strength"))


def scenario_edges(snapshots: DataFrame) -> DataFrame:
    """snapshots(id, opportunities: array, risks: array) -> (source_id, kind, name), source ids `<id>:<kind>:<place>`."""
    one = lambda kind: snapshots.select("id", F.lit(kind).alias("kind"), F.posexplode(kind).alias("place", "name"))
    both = one("opportunities").unionByName(one("risks"))
    return both.select(F.concat_ws(":", "id", "kind", "place").alias("source_id"), "kind", "name")


def merge_material(items: DataFrame) -> DataFrame:
    """items(doc, refs: array of reference ids) -> (doc, ref, n): each reference once in a document, numbered by its first place."""
    places = items.select("doc", F.posexplode("refs").alias("place", "ref"))
    first = places.groupBy("doc", "ref").agg(F.min("place").alias("place"))
    return first.select("doc", "ref", F.row_number().over(Window.partitionBy("doc").orderBy("place")).alias("n"))


def unknown_references(used: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_except(used, allowed))


def last_stress(points: DataFrame, days: int = 10) -> DataFrame:
    """points(series, day, value, or null): the value of the day, else the last one of the days before, if it isn't too old."""
    w = Window.partitionBy("series").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("value").isNotNull(), F.struct("day", "value")), ignorenulls=True).over(w)
    p = points.withColumn("_s", seen)
    fresh = F.datediff("day", "_s.day") <= days
    return p.select("series", "day", F.when(fresh, F.col("_s.value")).alias("value"), F.when(fresh, F.datediff("day", "_s.day")).alias("age"))
