"""Reads of stored rows: the newest ones, filter scans, edges of eligible events, merged streams, sums with a verdict, work to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times, titles

#: Sources that count as at first hand, and the ranks of impacts. Fixed values.
FIRST_HAND, IMPACT = ("official", "first_party"), ("low", "medium", "high", "critical")
SYMBOL = r"^[A-Z][A-Z0-9.-]{0,9}$"


def latest(rows: DataFrame, order: list[str], condition: Column | None = None) -> DataFrame:
    """The newest row by the columns named, of those that meet the condition; each task keeps one row."""
    kept = rows if condition is None else rows.where(condition)
    return kept.orderBy(*[F.desc(c) for c in order]).limit(1)


def history(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The newest n rows, oldest first."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def fresh_briefing(snapshots: DataFrame, version: int, now: Column, hours: int = 24, among: int = 64) -> DataFrame:
    """Snapshots(id, schema_version, source_as_of, generated_at, imported_at, payload): the newest one that parses and whose sources aren't older than the hours, nor ahead of the clock by over five minutes."""
    order = [F.desc(c) for c in ("source_as_of", "generated_at", "imported_at", "id")]
    ahead = now + F.expr("INTERVAL 5 MINUTES")
    fresh = F.col("source_as_of").between(now - F.make_interval(hours=F.lit(hours)), ahead) & (F.col("generated_at") <= ahead)
    parses = F.try_parse_json("payload").isNotNull()
    return snapshots.where(F.col("schema_version") == version).orderBy(*order).limit(among).where(fresh & parses).orderBy(*order).limit(1)


def with_staleness(snapshots: DataFrame, now: Column, stale_after: int = 7 * 86400) -> DataFrame:
    """Snapshots(source_as_of or null, created_at) with age_seconds (0 at least), clock_skew (over five minutes ahead) and is_stale."""
    raw = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.coalesce("source_as_of", "created_at").cast("timestamp"))
    skew, age = raw < -300, F.greatest(raw, F.lit(0))
    return snapshots.select("*", age.alias("age_seconds"), skew.alias("clock_skew"), (skew | (age > stale_after)).alias("is_stale"))


def source_ids(events: DataFrame) -> DataFrame:
    """(source_id): the ids of events(event_id, dedup_key) as text, and their keys that aren't blank, each once."""
    keys = events.where(F.trim("dedup_key") != "").select(F.col("dedup_key").alias("source_id"))
    return events.select(F.col("event_id").cast("string").alias("source_id")).union(keys).distinct()


def eligible_events(events: DataFrame, sightings: DataFrame, now: Column | None = None, hours: int | None = None) -> DataFrame:
    """Events with an eligible sighting(event_id, eligible, time_status, published_at); with hours, one of a verified time within them."""
    good = sightings.where("eligible")
    if hours is not None:
        good = good.where((F.col("time_status") == "verified") & F.col("published_at").between(now - F.make_interval(hours=F.lit(hours)), now))
    return events.join(good.select("event_id"), "event_id", "left_semi")


def _kind(name: str) -> Column:
    return F.lower(F.trim("source_type")) == name


def scan(rows: DataFrame, equal: dict[str, str], order: list[str], most: int, ids: DataFrame | None = None) -> DataFrame:
    """The newest rows whose columns have the values asked for; with ids, those of events only where their source is among them."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    if ids is not None:
        rows = rows.where(~_kind("event")).unionByName(rows.where(_kind("event")).join(ids, "source_id", "left_semi"))
    return rows.orderBy(*[F.desc(c) for c in order]).limit(max(1, most))


def validation_edges(edges: DataFrame, events: DataFrame, sightings: DataFrame, now: Column, hours: int = 14 * 24) -> DataFrame:
    """Edges(source_type, source_id, ...) of events that were verified within the hours."""
    return edges.where(_kind("event")).join(source_ids(eligible_events(events, sightings, now, hours)), "source_id", "left_semi")


def decision_edges(edges: DataFrame, events: DataFrame, sightings: DataFrame, snapshots: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """The edges of recent events, and those of the last of snapshots(id): its id, or its id and a colon, starts their source."""
    last = snapshots.agg(F.max("id").cast("string").alias("_last"))
    # The one row of an aggregate is the side to broadcast.
    macro = edges.where(_kind("macro_snapshot")).join(F.broadcast(last), F.substring_index("source_id", ":", 1) == F.col("_last"), "left_semi")
    return validation_edges(edges, events, sightings, now, hours).unionByName(macro)


def monitored(indicators: DataFrame, policies: DataFrame, n: int = 24) -> DataFrame:
    """Both streams(event_id, published_at, ...) newest first, undated ones last, n of them."""
    both = indicators.withColumn("_s", F.lit(0)).unionByName(policies.withColumn("_s", F.lit(1)))
    return both.orderBy(F.desc_nulls_last("published_at"), "_s", "event_id").limit(n).drop("_s")


def policy_events(items: DataFrame, now: Column, days: int = 14, n: int = 24) -> DataFrame:
    """Items(item_id, title, url, published or null): a url once, the newest of it, dated by the item or else by its url; none over the days old or five minutes ahead. `pol_` and a hash is the id."""
    dated = items.select("item_id", F.trim("title").alias("title"), F.trim("url").alias("url"), F.coalesce("published", times.url_stamp(F.col("url"))).alias("published_at")).where("title <> '' AND url <> ''")
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("published_at").cast("timestamp"))
    recent = dated.where(F.col("published_at").isNull() | age.between(-298, days * 86400))
    newest = Window.partitionBy("url").orderBy(F.desc_nulls_last("published_at"), "item_id")
    once = recent.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")
    status = F.when(F.col("published_at").isNull(), "unknown").otherwise("verified")
    return once.select(F.concat(F.lit("pol_"), F.left(F.sha2("url", 256), F.lit(12))).alias("event_id"), "title", "url", "published_at", status.alias("time_status")).orderBy(F.desc_nulls_last("published_at"), "event_id").limit(n)


def tier_coverage(items: DataFrame) -> DataFrame:
    """Items(tier, ai_used, time_status): how many there are, of each tier, with a summary, with a verified time."""
    tiers = [F.count_if(F.lower("tier") == t).alias(t) for t in ("official", "first_party", "reporting", "discovery")]
    return items.agg(F.count("*").alias("total"), *tiers, F.count_if("ai_used").alias("ai_ready"), F.count_if(F.col("time_status") == "verified").alias("time_verified"))


def firsthand(items: DataFrame, n: int = 6) -> DataFrame:
    """Items(story_key, tier, impact, age_minutes) at first hand: those up to 90 minutes old first, then by impact, time and key."""
    fresh = F.col("age_minutes").between(0, 90)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in IMPACT]), F.col("impact")), F.lit(0))
    return items.where(F.col("tier").isin(*FIRST_HAND)).orderBy(F.coalesce(fresh, F.lit(False)).desc(), rank.desc(), F.asc_nulls_last("age_minutes"), "story_key").limit(n)


def position_values(positions: DataFrame, targets: DataFrame) -> DataFrame:
    """Positions(account, symbol, market_value) and targets(account, target): (account, value of the target), null where any position is unfit."""
    fit = F.coalesce(F.col("symbol").rlike(SYMBOL) & (F.col("market_value") >= 0), F.lit(False))
    j = targets.join(positions.withColumn("_fit", fit), "account", "left")
    held = F.coalesce(F.sum(F.when(F.col("symbol") == F.col("target"), F.col("market_value"))), F.lit(0))
    return j.groupBy("account").agg(F.when(F.coalesce(F.bool_and("_fit"), F.lit(True)), held).alias("target_value"))


def option_exposures(options: DataFrame, targets: DataFrame) -> DataFrame:
    """Options(account, underlying, reserve, strategy or null) and targets(account, target): (account, total, target_exposure), null where any option is unfit: no positive reserve, or another strategy."""
    fit = F.coalesce(F.col("underlying").rlike(SYMBOL) & (F.col("reserve") > 0), F.lit(False)) & F.coalesce(F.col("strategy") == "cash_secured_short_put", F.lit(True))
    g = targets.join(options.withColumn("_fit", fit), "account", "left").groupBy("account")
    zero, all_fit = F.lit(0), F.coalesce(F.bool_and("_fit"), F.lit(True))
    own = F.sum(F.when(F.col("underlying") == F.col("target"), F.col("reserve")))
    return g.agg(F.when(all_fit, F.coalesce(F.sum("reserve"), zero)).alias("total"), F.when(all_fit, F.coalesce(own, zero)).alias("target_exposure"))


def window_rows(results: DataFrame, defaults: list[str]) -> DataFrame:
    """Results(windows: map of structs, ...) to a row for each of 1D, 3D and 5D; the columns in defaults stand in for fields that a window leaves null."""
    rows = results.select(*[c for c in results.columns if c != "windows"], F.explode(F.map_entries("windows")).alias("_w")).where(F.col("_w.key").isin("1D", "3D", "5D"))
    fields = results.schema["windows"].dataType.valueType.fieldNames()
    value = {f: F.coalesce(F.col(f"_w.value.{f}"), F.col(f)) if f in defaults else F.col(f"_w.value.{f}") for f in fields}
    outer = [c for c in rows.columns if c != "_w" and c not in fields]
    return rows.select(*outer, F.col("_w.key").alias("window"), *[v.alias(f) for f, v in value.items()])


def policy_verdicts(history_: DataFrame, requests: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """History(owner, revision, digest, review_due) and one request(owner, digest, expected) an owner: (owner, verdict, revision, review_due).

    An equal policy whose review isn't due is idempotent; another needs the current revision (0 where there is none), else it is a conflict.
    """
    current = history_.groupBy("owner").agg(F.max_by(F.struct("revision", "digest", "review_due"), "revision").alias("c"))
    j = requests.join(current, "owner", "left")
    same = F.coalesce((F.col("c.digest") == F.col("digest")) & (now < F.col("c.review_due")), F.lit(False))
    at = F.coalesce("c.revision", F.lit(0))
    verdict = F.when(same, "idempotent").when(F.col("expected") != at, "conflict").otherwise("saved")
    saved = verdict == "saved"
    return j.select("owner", verdict.alias("verdict"), F.when(saved, at + 1).otherwise(at).alias("revision"), F.when(saved, now + F.make_interval(days=F.lit(days))).otherwise(F.col("c.review_due")).alias("review_due"))


def pruned_days(rows: DataFrame, current: int, reference: Column, days: int = 45, most: int = 64) -> DataFrame:
    """Snapshots(id, day, generated_at, imported_at, valid) of the last days up to the newest valid one (the reference day at least), the newest of them; the current one always stays."""
    newest = rows.agg(F.greatest(F.max(F.when(F.col("valid"), F.col("day"))), reference).alias("_newest"), F.lit(1).alias("_one"))
    other = F.col("id") != current
    # The one row of an aggregate is the side to broadcast.
    kept = rows.withColumn("_one", F.lit(1)).join(F.broadcast(newest), "_one").where(~other | (F.col("day") > F.date_sub("_newest", days))).drop("_one", "_newest")
    order = [F.desc("generated_at"), F.desc("imported_at"), F.desc("id")]
    return kept.where(other).orderBy(*order).limit(most - 1).unionByName(kept.where(~other))


def discovered(items: DataFrame, known: DataFrame, now: Column, hours: int = 48, most: int = 60) -> DataFrame:
    """Items(source, item_id, published_at or null) of the last hours or undated; of a source that isn't among known(source), its newest 60 alone."""
    recent = items.where(F.col("published_at").isNull() | (F.col("published_at") >= now - F.make_interval(hours=F.lit(hours))))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("published_at"), "item_id"))
    first = recent.join(known, "source", "left_anti").withColumn("_k", place).where(F.col("_k") <= most).drop("_k")
    return recent.join(known, "source", "left_semi").unionByName(first)


def merged_content(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Contents(keys, title, snippet, tickers: array, substantive), one observation of an identity a side: substance beats a shell, an unrelated title replaces, else the longer texts and all tickers stay."""
    names = ("title", "snippet", "tickers", "substantive")
    old, new = (df.select(*keys, F.struct(*names).alias(side)) for df, side in ((existing, "o"), (incoming, "n")))
    j = old.join(new, keys, "full")
    a, b = titles.normal_title(F.col("o.title")), titles.normal_title(F.col("n.title"))
    keeps = F.col("n").isNull() | (F.col("o.substantive") & ~F.col("n.substantive"))
    takes = F.col("o").isNull() | (F.col("n.substantive") & ~F.col("o.substantive")) | ((a != b) & ~titles.is_prefix_duplicate(a, b))
    longer = lambda c: F.when(F.length(f"n.{c}") >= F.length(f"o.{c}"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    pick = lambda c, both: F.when(keeps, F.col(f"o.{c}")).when(takes, F.col(f"n.{c}")).otherwise(both)
    tickers = F.array_sort(pick("tickers", F.array_union("o.tickers", "n.tickers")))
    return j.select(*keys, pick("title", longer("title")).alias("title"), pick("snippet", longer("snippet")).alias("snippet"), tickers.alias("tickers"))


def failed_sources(sources: DataFrame, failures: DataFrame) -> DataFrame:
    """Sources(source, failures, last_error) after a batch of failures(source, code, at): counted on, with the last code."""
    seen = failures.groupBy("source").agg(F.count("*").alias("_n"), F.max_by("code", F.struct("at", "code")).alias("_code"))
    j = sources.join(seen, "source", "left")
    return j.select("source", (F.col("failures") + F.coalesce("_n", F.lit(0))).alias("failures"), F.coalesce("_code", "last_error").alias("last_error"))


def failed_claims(claims: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Claims(task, token, status, error, next_attempt) after failures(task, token, code, retry_seconds or null), one a task: only the holder of the token of a task in processing may fail it, for good or for a minute at least."""
    j = claims.join(failures.select("task", F.col("token").alias("_t"), "code", "retry_seconds"), "task", "left")
    holds = F.coalesce((F.col("_t") == F.col("token")) & (F.col("status") == "processing"), F.lit(False))
    again = F.col("retry_seconds").isNotNull()
    code = F.left(F.regexp_replace(F.lower("code"), "[^a-z0-9_:-]", ""), F.lit(48))
    due = F.when(again, now + F.make_interval(secs=F.greatest(F.col("retry_seconds"), F.lit(60))))
    return j.select(
        "task", F.when(holds, "").otherwise(F.col("token")).alias("token"), F.when(holds, F.when(again, "retry").otherwise("failed")).otherwise(F.col("status")).alias("status"),
        F.when(holds, F.coalesce(F.nullif(code, F.lit("")), F.lit("unknown"))).otherwise(F.col("error")).alias("error"), F.when(holds, due).otherwise(F.col("next_attempt")).alias("next_attempt"),
    )


def recovered(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Jobs(job, state, interruptions) after a crash: running ones queue again, but for those that were interrupted so often, which fail."""
    running, spent = F.col("state") == "running", F.col("interruptions") >= most
    state = F.when(running & spent, "failed").when(running, "queued").otherwise(F.col("state"))
    return jobs.select("job", state.alias("state"), (F.col("interruptions") + F.when(running & ~spent, 1).otherwise(0)).alias("interruptions"))


def job_snapshot(jobs: DataFrame, n: int = 250) -> DataFrame:
    """Running jobs(job, state, updated_at), then queued ones, then the rest, the last updated first."""
    return jobs.orderBy(F.when(F.col("state") == "running", 0).when(F.col("state") == "queued", 1).otherwise(2), F.desc("updated_at"), "job").limit(n)


def daily_budget(attempts: DataFrame, most: int = 400) -> DataFrame:
    """Attempts(ts) by their day in Beijing: (day, used, remaining)."""
    day = F.to_date(times.beijing(F.col("ts")))
    return attempts.groupBy(day.alias("day")).agg(F.count("*").alias("used")).withColumn("remaining", F.greatest(F.lit(most) - F.col("used"), F.lit(0)))


def decorated(items: DataFrame, cache: DataFrame, now: Column, configured: bool = True) -> DataFrame:
    """Items(item_id, input_hash, published_at, published_status) with the state of their analysis: that of cache(item_id, input_hash, status) where its hash is the item's; a recent item without one is pending."""
    recent = (F.col("published_status") == "provided") & F.col("published_at").between(now - F.make_interval(hours=F.lit(48)), now)
    held = F.when(F.col("_status") == "running", "pending").otherwise(F.col("_status"))
    none = F.when(F.coalesce(recent, F.lit(False)), "pending" if configured else "unavailable").otherwise("not_scheduled")
    j = items.join(cache.select("item_id", "input_hash", F.col("status").alias("_status")), ["item_id", "input_hash"], "left")
    return j.select("item_id", F.coalesce(held, none).alias("analysis_status"))


def overflow(majors: DataFrame, highlights: DataFrame) -> DataFrame:
    """Major items that aren't among the highlights."""
    return majors.join(highlights.select("story_key"), "story_key", "left_anti")


def new_posts(posts: DataFrame, last: str | None, first: int = 5) -> DataFrame:
    """Posts(post, place): all but the one that was seen last, older ones included; at the first run the first five."""
    return posts.where(F.col("post") != last) if last else posts.orderBy("place").limit(first)


def latest_per_source(episodes: DataFrame, now: Column) -> DataFrame:
    """Episodes(source, episode, published_at): the newest of each source that isn't ahead of the clock, the first id of equal times."""
    seen = episodes.where(F.col("published_at") <= now)
    return seen.groupBy("source").agg(F.min_by("episode", F.struct(-F.unix_micros(F.col("published_at").cast("timestamp")), "episode")).alias("episode"))


def completed_claims(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claims(task, token, status, result) after results(task, token, result), one a task: only the holder of the token of a task in processing completes it."""
    j = claims.join(results.select("task", F.col("token").alias("_t"), F.col("result").alias("_r")), "task", "left")
    holds = F.coalesce((F.col("_t") == F.col("token")) & (F.col("status") == "processing"), F.lit(False))
    new = {"token": F.lit(""), "status": F.lit("ready"), "result": F.col("_r")}
    return j.select("task", *[F.when(holds, v).otherwise(F.col(c)).alias(c) for c, v in new.items()])


def revoked_claims(claims: DataFrame, subjects: DataFrame) -> DataFrame:
    """Claims(task, input_hash, token, status) against subjects(task, input_hash) of today: where the evidence is another or gone, the task is pending and its token void."""
    j = claims.join(subjects.select("task", F.col("input_hash").alias("_now")), "task", "left")
    stale = ~F.col("input_hash").eqNullSafe(F.col("_now")) | F.col("_now").isNull()
    return j.select("task", "input_hash", F.when(stale, "").otherwise(F.col("token")).alias("token"), F.when(stale, "pending").otherwise(F.col("status")).alias("status"))


def automatic(articles: DataFrame, baselines: DataFrame, initial: DataFrame, tracked: DataFrame) -> DataFrame:
    """Articles(article, source, published, body_hash, summarised) to be summarised unasked: with a body and no summary, and of the first set, newer than baselines(source, published_after), or with another body than tracked(article, body_hash)."""
    j = articles.join(baselines, "source").join(initial.select("article", F.lit(True).alias("_first")), "article", "left").join(tracked.select("article", F.col("body_hash").alias("_was")), "article", "left")
    due = F.col("_first").isNotNull() | F.coalesce(F.col("published") > F.col("published_after"), F.lit(False)) | F.coalesce(F.col("_was") != F.col("body_hash"), F.lit(False))
    return j.where(due & (F.coalesce("body_hash", F.lit("")) != "") & ~F.col("summarised")).select("article", "source")
