"""Queries on decision cards, feeds, queues, merges and retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules, times
from ..functions.rounding import nearest
from ..operators import decisions, queues, store
from ..sources.tables import table
from .common import shown

_NOW, COVERAGE = "2024-01-31 12:00:00", 0.8


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


def _events(spark, d):
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")


def _edges(spark, d):
    e, k = _events(spark, d), F.col("event_id")
    source = F.when(k % 10 == 0, "macro").otherwise("event")
    return e.select(
        k.alias("edge_id"), source.alias("source_type"), (k % 997).cast("string").alias("source_id"), F.col("event_type").alias("topic"), F.concat(F.lit("US:"), F.col("user_id") % 12).alias("asset"),
        F.when(F.col("value") > 12, "positive").when((F.col("user_id") % 12 < 4) & (F.col("value") < 3), "negative").otherwise("neutral").alias("direction"),
        rules.strength(F.when(F.col("value") > 60, "high").when(F.col("value") > 20, "medium").otherwise("low"), F.lit("positive"), source == "event").alias("strength"),
        rules.confidence(F.lit(True), F.when(k % 4 == 0, "unknown").otherwise("bullish"), F.lit("rates"), source == "event").alias("confidence"),
        F.get(F.array(*[F.lit(x) for x in ("short", "medium", "long", "unknown", "short")]), (F.col("user_id") % 5).cast("int")).alias("horizon"), F.col("ts").alias("event_ts"),
    )


def _reactions(spark, d):
    e, k = _events(spark, d), F.col("event_id")
    span = F.explode(F.array(F.lit("1D"), F.lit("3D"), F.lit("5D"))).alias("window")
    r = e.select(k, (k % 997).cast("string").alias("source_id"), F.concat(F.lit("US:"), F.col("user_id") % 12).alias("asset"), "value", span)
    hours = F.substring("window", 1, 1).cast("int")
    return r.select(
        "source_id", "asset", "window", F.when((k + hours) % 97 == 0, "unavailable").when((k + hours) % 11 == 0, "pending").otherwise("complete").alias("status"), (hours + 2).alias("sample_count"),
        F.when(F.col("asset").isin("US:1", "US:5", "US:9"), "up").when((k + hours) % 50 == 0, "flat").when(F.col("value") > 1.5, "up").otherwise("down").alias("direction"),
    )


def _cards(spark, d):
    return decisions.decision_cards(_edges(spark, d), _reactions(spark, d), _now(), COVERAGE)


def decision_cards(spark, d):
    return shown(_cards(spark, d), 4)


def decision_overview(spark, d):
    return decisions.overview(_cards(spark, d))


def decision_order(spark, d):
    return _cards(spark, d).select("topic", "asset", F.row_number().over(Window.orderBy(*decisions.card_order())).alias("place"))


def impact_matrix(spark, d):
    m = decisions.impact_matrix(_cards(spark, d), [f"US:{k}" for k in range(12)])
    return shown(m.select("topic", *[F.col(f"`US:{k}`").alias(f"us_{k}") for k in range(12)]), 4)


def diversified_top_k(spark, d):
    return shown(decisions.select_summary(_cards(spark, d), 12), 4)


def eligible_edges(spark, d):
    return decisions.eligible(_edges(spark, d), _now()).select("edge_id", nearest(F.col("age_days"), 4).alias("age_days"), rules.freshness(F.col("age_days")).alias("freshness"))


def group_horizon(spark, d):
    return decisions.dominant(_edges(spark, d), ["topic", "asset"], "horizon", "horizon")


def edge_dedup(spark, d):
    """Of the edges with one topic, asset and source the surest stays, then the strongest, then the last."""
    best = F.max_by("edge_id", F.struct("confidence", "strength", "edge_id"))
    return _edges(spark, d).groupBy("topic", "asset", "source_id").agg(best.alias("edge_id"), F.count("*").alias("edges"))


def event_counters(spark, d):
    e = _events(spark, d).where(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz"))
    high, medium = F.col("value") > 20, F.col("value").between(5, 20)
    return e.agg(F.count("*").alias("total"), F.count_if(high).alias("high"), F.count_if(medium).alias("medium"), F.greatest(F.lit(0), F.count("*") - F.count_if(high) - F.count_if(medium)).alias("low"), F.count_if(F.col("event_type") == "purchase").alias("market"), F.count_distinct("user_id").alias("active"))


def person_summary(spark, d):
    e = _events(spark, d)
    day = F.col("ts") >= F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")
    seen = e.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(day).alias("last_day"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    directory = table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("user_id"))
    return directory.join(seen, "user_id", "full").select("user_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("last_day", F.lit(0)).alias("last_day"), "latest")


def relations_semi(spark, d):
    """Customers with an order above 400,000, and all of those of one segment."""
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    rich = table(spark, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    other = c.where("c_mktsegment = 'BUILDING'")
    return c.where("c_mktsegment <> 'BUILDING'").join(rich, "c_custkey", "left_semi").unionByName(other)


def anti_unmatched(spark, d):
    return table(spark, d, "customer", "c_custkey", "c_name").join(table(spark, d, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def latest_quote(spark, d):
    """Positions with the latest order of their customer and the exposure at its price."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    last = o.groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("price"))
    p = table(spark, d, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") + 1).alias("quantity"))
    return p.join(last, "o_custkey", "left").select("o_custkey", "quantity", "price", F.round(F.col("price") * F.col("quantity"), 2).alias("exposure"))


def status_merge(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    s = o.select((F.col("o_custkey") % 300).alias("key"), F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "preliminary").otherwise("pending").alias("status"), F.col("o_orderdate").alias("observed_at"), F.col("o_orderkey").alias("row_id"))
    # Equal times are told apart by id, as one batch would by order.
    merged = store.upsert(s.where("row_id % 2 = 0"), s.where("row_id % 2 = 1"), ["key"], [store.status_rank(F.col("status")).desc(), F.col("observed_at").desc(), F.col("_incoming").desc(), F.col("row_id").desc()])
    return merged.select("key", "status", "row_id")


def price_upsert(spark, d):
    e = _events(spark, d).select(F.col("event_type").alias("asset"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"), "value", "event_id")
    return store.upsert_last(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["asset", "hour"], "event_id").select("asset", "hour", "value", "event_id")


def replace_relations(spark, d):
    e = _edges(spark, d).select("source_id", "topic", "asset", F.col("edge_id").alias("id"), "strength")
    e = e.groupBy("source_id", "topic", "asset").agg(F.min("id").alias("id"), F.max("strength").alias("strength"))
    old, new = e, e.where("cast(source_id AS int) < 300 AND topic <> 'view'").withColumn("id", F.col("id") + 1_000_000).withColumn("strength", F.lit(1.0))
    return store.replace_groups(old, new, "source_id", ["source_id", "topic", "asset"], ["id"])


def keep_newest(spark, d):
    return store.keep_newest(_events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


def retention(spark, d):
    return store.retain(_events(spark, d), "ts", _now(), 14).groupBy("event_type").agg(F.count("*").alias("kept"), F.min("event_id").alias("first_id"))


def retention_cascade(spark, d):
    edges = _events(spark, d).select(F.concat_ws(":", "event_id", "event_type").alias("source_id"), F.col("user_id").alias("asset"))
    _, left = store.retain_with_edges(_events(spark, d), edges, "event_id", "ts", _now(), 10)
    return left.groupBy("asset").agg(F.count("*").alias("edges"))


def insert_absent(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("hash"), F.col("c_custkey").alias("id"))
    old = old.groupBy("hash").agg(F.min("id").alias("id")).where("hash < 15")
    return store.insert_absent(old, c.select(F.col("c_nationkey").alias("hash"), F.col("c_custkey").alias("id")), ["hash"])


def snapshot_merge(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate").select(F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 5).alias("generated_at"), F.col("o_orderkey").alias("payload"))
    old = o.where("payload % 2 = 0").groupBy("day").agg(F.max("generated_at").alias("generated_at"), F.max("payload").alias("payload"))
    new = o.where("payload % 2 = 1").groupBy("day").agg(F.max("generated_at").alias("generated_at"), F.min("payload").alias("payload"))
    return shown(store.merge_snapshots(old, new)[0])


def revisions(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return store.versions(o, "o_custkey", "o_orderkey", "o_orderstatus")


def sighting_merge(spark, d):
    e = _events(spark, d)
    k = F.col("event_id")
    rows = e.select(F.col("user_id").alias("event_id"), F.col("event_type").alias("kol_key"), (k % 3).alias("source"), F.lit("u").alias("source_url"), F.when(k % 4 > 0, F.col("ts") + F.expr("INTERVAL 10 MINUTES") * (k % 2)).alias("published_at"), F.col("ts").alias("seen_at"))
    rows = rows.withColumn("time_status", store.publication_status(F.col("published_at"), F.col("seen_at")))
    return store.merge_sightings(rows).select("event_id", "kol_key", "source", "observations", "time_status", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


def quota_window(spark, d):
    e = queues.gaps(_events(spark, d), "event_type", "ts", "event_id")
    r = queues.rolling_counts(e, "event_type", "ts", {"hour": 3600, "day": 86400})
    return r.select("event_id", "hour", "day", queues.quota_verdict(F.coalesce("gap", F.lit(99999)), F.col("hour"), F.col("day"), most_day=60).alias("verdict"))


def interleaved(spark, d):
    t = _events(spark, d).where("event_type IN ('error', 'purchase')")
    return queues.interleave(t, "event_type", [F.desc("value"), F.asc("event_id")]).select("event_id", "event_type", "place")


def superseded_jobs(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("article"), (F.col("o_orderkey") % 7).alias("version"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("state"))
    return queues.supersede(jobs)


def due_selection(spark, d):
    e = _events(spark, d).select(F.col("event_id").alias("edge_id"), F.col("ts").alias("due_at"), (F.col("event_id") % 5 == 0).alias("retry"))
    return queues.select_due(e, 40).select("edge_id", "retry", "tier")


def usage_summary(spark, d):
    e = _events(spark, d)
    k = F.col("event_id")
    calls = e.select(F.when(k % 3 == 0, "ok").otherwise("failed").alias("status"), F.when(k % 2 == 0, k).alias("tokens_in"), F.col("user_id").alias("tokens_out"), F.when(k % 5 > 0, (k % 60).cast("double")).alias("seconds"))
    return shown(queues.usage(calls))


def slots(spark, d):
    return _events(spark, d).groupBy(times.slot(F.col("ts")).alias("slot")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


def editions(spark, d):
    return _events(spark, d).select("event_id", times.edition(F.col("ts")).alias("edition"), times.peak(F.col("ts"), ["2024-01-01"]).alias("peak"))


QUERIES = {
    f.__name__: f
    for f in (
        decision_cards, decision_overview, decision_order, impact_matrix, diversified_top_k, eligible_edges, group_horizon, edge_dedup, event_counters, person_summary, relations_semi, anti_unmatched, latest_quote,
        status_merge, price_upsert, replace_relations, keep_newest, retention, retention_cascade, insert_absent, snapshot_merge, revisions, sighting_merge, quota_window, interleaved, superseded_jobs, due_selection,
        usage_summary, slots, editions,
    )
}
_E = """e0 AS (SELECT event_id AS edge_id, CASE WHEN event_id % 10 = 0 THEN 'macro' ELSE 'event' END AS source_type, CAST(event_id % 997 AS VARCHAR) AS source_id, event_type AS topic, 'US:' || (user_id % 12) AS asset,
  CASE WHEN value > 12 THEN 'positive' WHEN user_id % 12 < 4 AND value < 3 THEN 'negative' ELSE 'neutral' END AS direction,
  round(least(CASE WHEN event_id % 10 <> 0 THEN 0.30::DOUBLE ELSE 0.45 END + CASE WHEN value > 60 THEN 0.30::DOUBLE WHEN value > 20 THEN 0.15 ELSE 0.05 END + 0.15::DOUBLE, 1.0), 2) AS strength,
  CASE WHEN event_id % 4 = 0 THEN 0.45::DOUBLE ELSE CASE WHEN event_id % 10 <> 0 THEN 0.90::DOUBLE ELSE 0.85 END END AS confidence,
  ['short', 'medium', 'long', 'unknown', 'short'][user_id % 5 + 1] AS horizon, ts AS event_ts FROM events),
e AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(event_ts)) / 86400e6 AS age_days FROM e0),
ok AS (SELECT * FROM e WHERE source_type <> 'event' OR (age_days >= 0 AND age_days * 24 <= CASE horizon WHEN 'short' THEN 72 WHEN 'long' THEN 336 ELSE 168 END))"""
_FRESH = "CASE WHEN age_days < -5.0/1440 THEN 0.0 WHEN age_days <= 1 THEN 1.0 WHEN age_days <= 3 THEN 0.9 WHEN age_days <= 7 THEN 0.75 WHEN age_days <= 30 THEN 0.5 WHEN age_days <= 90 THEN 0.25 ELSE 0.1 END"
_H = """hc AS (SELECT topic, asset, horizon, count(*) AS n FROM {} GROUP BY ALL), hm AS (SELECT topic, asset, max(n) AS most FROM hc GROUP BY ALL),
gh AS (SELECT topic, asset, CASE WHEN count(*) > 1 THEN 'mixed' ELSE min(horizon) END AS horizon FROM hc JOIN hm USING (topic, asset) WHERE n = most GROUP BY ALL)"""


def _mean(value: str) -> str:
    return f"round(sum(CAST(round(CAST({value} AS DOUBLE) * 10000) AS BIGINT)) / (count(*) * 10000.0::DOUBLE), 4)"


_CARDS = f"""{_E}, {_H.format("ok")},
g AS (SELECT topic, asset, bool_or(direction = 'positive') AS pos, bool_or(direction = 'negative') AS neg, count(*) AS edges, bool_or(source_type = 'event') AS has_event, {_mean('strength')} AS c_strength,
  {_mean("confidence * CASE WHEN source_type = 'event' THEN 1.0::DOUBLE ELSE 0.9 END")} AS c_confidence, {_mean(_FRESH)} AS c_freshness,
  CASE least(count(DISTINCT (source_type, source_id)), 4) WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.85 WHEN 2 THEN 0.65 ELSE 0.35 END AS c_corroboration FROM ok GROUP BY ALL),
k AS (SELECT g.*, gh.horizon, CASE WHEN pos AND NOT neg THEN 'opportunity' WHEN neg AND NOT pos THEN 'risk' ELSE 'conflict' END AS classification, CASE WHEN pos AND NOT neg THEN 'up' WHEN neg AND NOT pos THEN 'down' END AS expected,
  CASE WHEN gh.horizon IN ('short', 'intraday') THEN '1D' WHEN gh.horizon IN ('long', 'mixed') THEN '5D' ELSE '3D' END AS required FROM g JOIN gh USING (topic, asset)),
ag AS (SELECT ok.topic, ok.asset, expected, required, source_id FROM ok JOIN k USING (topic, asset) WHERE source_type = 'event' AND CASE direction WHEN 'positive' THEN 'up' WHEN 'negative' THEN 'down' END = expected),
re AS (SELECT CAST(event_id % 997 AS VARCHAR) AS source_id, 'US:' || (user_id % 12) AS asset, w || 'D' AS win, CASE WHEN (event_id + w) % 97 = 0 THEN 'unavailable' WHEN (event_id + w) % 11 = 0 THEN 'pending' ELSE 'complete' END AS status, w + 2 AS sample_count,
  CASE WHEN user_id % 12 IN (1, 5, 9) THEN 'up' WHEN (event_id + w) % 50 = 0 THEN 'flat' WHEN value > 1.5 THEN 'up' ELSE 'down' END AS observed FROM events, (VALUES (1), (3), (5)) v(w)),
ma AS (SELECT topic, ag.asset, required, win, status, status = 'complete' AND sample_count >= CASE win WHEN '1D' THEN 2 WHEN '3D' THEN 4 ELSE 6 END AS done, CASE WHEN observed IN ('up', 'down') THEN observed = expected END AS agrees FROM ag JOIN re ON ag.source_id = re.source_id AND ag.asset = re.asset),
wi AS (SELECT topic, asset, win, required, bool_or(done AND agrees IS NOT NULL AND NOT agrees) AS contrary, bool_or(done AND agrees IS NULL) AS unclear, bool_and(done AND coalesce(agrees, false)) AS confirms, bool_and(done) AS done,
  bool_or(status = 'unavailable' AND win <= required) AS lost, bool_or(status = 'pending') AS pending FROM ma GROUP BY ALL),
ve AS (SELECT topic, asset, bool_or(contrary) AS contrary, bool_or(unclear) AS unclear, bool_or(lost) AS lost, max(CASE WHEN confirms THEN win END) AS confirmed, bool_or(win = required AND done) AS rd, bool_and(pending) AS ap FROM wi GROUP BY ALL),
aa AS (SELECT DISTINCT topic, asset, true AS has_agreeing FROM ag),
x AS (SELECT k.*, confirmed, coalesce(contrary, false) AS contrary, coalesce(unclear, false) AS unclear, coalesce(lost, false) AS lost, coalesce(rd, false) AS required_done, coalesce(ap, false) AS ap, expected IS NULL OR has_agreeing IS NULL AS nodir
  FROM k LEFT JOIN ve USING (topic, asset) LEFT JOIN aa USING (topic, asset)),
y AS (SELECT *, NOT has_event OR nodir OR contrary OR unclear OR lost AS veto, CASE WHEN NOT has_event THEN 'no_event_anchor' WHEN nodir THEN 'direction_unavailable' WHEN contrary THEN 'contrary' WHEN unclear THEN 'inconclusive'
  WHEN confirmed IS NOT NULL THEN 'confirmed_' || lower(confirmed) WHEN ap THEN 'awaiting_1d' ELSE 'unavailable' END AS phase FROM x),
z AS (SELECT *, veto OR confirmed IS NULL OR NOT required_done AS abstain, CASE WHEN veto THEN 0.0::DOUBLE ELSE CASE confirmed WHEN '1D' THEN 0.55::DOUBLE WHEN '3D' THEN 0.80 WHEN '5D' THEN 1.0 ELSE 0.0 END END AS market_score FROM y),
t AS (SELECT *, round(c_strength * 0.20::DOUBLE + c_confidence * 0.20::DOUBLE + c_freshness * 0.15::DOUBLE + c_corroboration * 0.15::DOUBLE + market_score * 0.20::DOUBLE + 0.8::DOUBLE * 0.10::DOUBLE, 4) AS score FROM z),
cards AS (SELECT topic, asset, horizon, edges, c_strength, c_confidence, c_freshness, c_corroboration, phase, veto, abstain, required_done, market_score, classification, score,
  CASE WHEN classification <> 'conflict' AND NOT abstain AND NOT veto AND required_done AND score >= 0.70 THEN CASE classification WHEN 'opportunity' THEN 'scale_in' ELSE 'reduce_or_hedge' END WHEN score >= 0.45 THEN 'verify' ELSE 'observe' END AS stage FROM t)"""
_CORDER = "CASE WHEN stage IN ('scale_in', 'reduce_or_hedge') THEN 0 WHEN stage = 'verify' THEN 1 ELSE 2 END, CASE WHEN NOT abstain THEN 0 WHEN NOT veto THEN 1 ELSE 2 END, score DESC, topic, asset"
SQL = {
    "decision_cards": f"WITH {_CARDS} SELECT * FROM cards",
    "decision_overview": f"WITH {_CARDS} SELECT count(*) AS total, count(*) FILTER (classification = 'opportunity') AS opportunities, count(*) FILTER (classification = 'risk') AS risks, count(*) FILTER (classification = 'conflict') AS conflicts, count(*) FILTER (stage IN ('scale_in', 'reduce_or_hedge')) AS candidates, count(*) FILTER (stage = 'verify') AS to_verify, count(*) FILTER (veto) AS vetoed, count(*) FILTER (NOT abstain) AS confirmed FROM cards",
    "decision_order": f"WITH {_CARDS} SELECT topic, asset, CAST(row_number() OVER (ORDER BY {_CORDER}) AS INTEGER) AS place FROM cards",
    "diversified_top_k": f"""WITH RECURSIVE {_CARDS}, o AS (SELECT *, row_number() OVER (ORDER BY {_CORDER}) AS place FROM cards),
r AS (
  SELECT CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS picks, CAST([] AS VARCHAR[]) AS ts, CAST([] AS VARCHAR[]) AS ys
  UNION ALL SELECT o.place, CASE WHEN take THEN list_append(picks, o.place) ELSE picks END, CASE WHEN take THEN list_append(ts, o.topic) ELSE ts END, CASE WHEN take THEN list_append(ys, o.asset) ELSE ys END
  FROM (SELECT r.*, o.place AS at_place, len(picks) < 12 AND (o.place <= 2 OR (len(list_filter(ts, lambda x: x = o.topic)) < 3 AND len(list_filter(ys, lambda x: x = o.asset)) < 2)) AS take FROM r JOIN o ON o.place = r.place + 1) s JOIN o ON o.place = s.at_place),
chosen AS (SELECT picks FROM r ORDER BY place DESC LIMIT 1),
filled AS (SELECT o.*, row_number() OVER (ORDER BY list_contains(picks, o.place) DESC, o.place) AS n FROM o, chosen)
SELECT * EXCLUDE (place, n) FROM filled WHERE n <= 12""",
    "impact_matrix": f"WITH {_CARDS} SELECT topic, {', '.join(f'''max(score) FILTER (asset = 'US:{k}') AS us_{k}''' for k in range(12))} FROM cards GROUP BY topic",
    "eligible_edges": f"WITH {_E} SELECT edge_id, round(age_days, 4) AS age_days, CAST({_FRESH} AS DOUBLE) AS freshness FROM ok",
    "group_horizon": f"WITH {_E}, {_H.format('e')} SELECT topic, asset, horizon FROM gh",
    "edge_dedup": f"WITH {_E} SELECT topic, asset, source_id, arg_max(edge_id, (confidence, strength, edge_id)) AS edge_id, count(*) AS edges FROM e GROUP BY ALL",
    "event_counters": "SELECT count(*) AS total, count(*) FILTER (value > 20) AS high, count(*) FILTER (value BETWEEN 5 AND 20) AS medium, greatest(0, count(*) - count(*) FILTER (value > 20) - count(*) FILTER (value BETWEEN 5 AND 20)) AS low, count(*) FILTER (event_type = 'purchase') AS market, count(DISTINCT user_id) AS active FROM events WHERE ts >= TIMESTAMP '2024-01-24'",
    "person_summary": "WITH s AS (SELECT user_id, count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-29 12:00:00') AS last_day, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1), c AS (SELECT c_custkey AS user_id FROM customer) SELECT user_id, coalesce(total, 0) AS total, coalesce(last_day, 0) AS last_day, latest FROM c FULL JOIN s USING (user_id)",
    "relations_semi": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "anti_unmatched": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "latest_quote": "WITH l AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY 1) SELECT c_custkey AS o_custkey, c_nationkey + 1 AS quantity, price, round(price * (c_nationkey + 1), 2) AS exposure FROM customer LEFT JOIN l ON c_custkey = o_custkey",
    "status_merge": "SELECT o_custkey % 300 AS key, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'preliminary' ELSE 'pending' END AS status, o_orderkey AS row_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 300 ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END DESC, o_orderdate DESC, o_orderkey % 2 DESC, o_orderkey DESC) = 1",
    "price_upsert": "SELECT event_type AS asset, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, floor(epoch(ts) / 3600) ORDER BY event_id % 2 DESC, event_id DESC) = 1",
    "replace_relations": f"WITH {_E}, o AS (SELECT source_id, topic, asset, min(edge_id) AS id, max(strength) AS strength FROM e GROUP BY ALL) SELECT source_id, topic, asset, id, CASE WHEN CAST(source_id AS INTEGER) < 300 AND topic <> 'view' THEN 1.0 ELSE strength END AS strength FROM o WHERE CAST(source_id AS INTEGER) >= 300 OR topic <> 'view' OR source_id NOT IN (SELECT source_id FROM o WHERE topic <> 'view')",
    "keep_newest": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3",
    "retention": "SELECT event_type, count(*) AS kept, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-17 12:00:00' GROUP BY 1",
    "retention_cascade": "SELECT user_id AS asset, count(*) AS edges FROM events WHERE ts >= TIMESTAMP '2024-01-21 12:00:00' GROUP BY 1",
    "insert_absent": "WITH o AS (SELECT c_nationkey AS hash, min(c_custkey) AS id FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1 HAVING c_nationkey < 15) SELECT * FROM o UNION ALL SELECT c_nationkey, min(c_custkey) FROM customer WHERE c_nationkey NOT IN (SELECT hash FROM o) GROUP BY 1",
    "snapshot_merge": "WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey % 5 AS g, o_orderkey AS p FROM orders), o AS (SELECT day, max(g) AS g, max(p) AS p FROM s WHERE p % 2 = 0 GROUP BY 1), n AS (SELECT day, max(g) AS g, min(p) AS p FROM s WHERE p % 2 = 1 GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, CASE WHEN o.g IS NULL OR n.g > o.g OR (n.g = o.g AND n.p = o.p) THEN n.g ELSE o.g END AS generated_at, CASE WHEN o.g IS NULL OR n.g > o.g OR (n.g = o.g AND n.p = o.p) THEN n.p ELSE o.p END AS payload FROM o FULL JOIN n USING (day)",
    "revisions": "WITH c AS (SELECT * FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders)) WHERE b IS NULL OR b <> o_orderstatus) SELECT o_orderkey, o_custkey, o_orderstatus, CAST(row_number() OVER w AS INTEGER) AS revision, lead(o_orderkey) OVER w AS valid_to FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "sighting_merge": "WITH r AS (SELECT user_id AS event_id, event_type AS kol_key, event_id % 3 AS source, ts, CASE WHEN event_id % 4 > 0 THEN ts + INTERVAL 10 MINUTE * (event_id % 2) END AS p, event_id % 2 AS late FROM events), s AS (SELECT *, CASE WHEN p IS NULL THEN 'unknown' WHEN late = 1 THEN 'future' ELSE 'verified' END AS st FROM r) SELECT event_id, kol_key, source, count(*) AS observations, arg_min(st, (CASE st WHEN 'verified' THEN 0 WHEN 'future' THEN 1 ELSE 2 END, ts)) AS time_status, CASE WHEN min(CASE st WHEN 'verified' THEN 0 WHEN 'future' THEN 1 ELSE 2 END) < 2 THEN strftime(arg_min(p, (CASE st WHEN 'verified' THEN 0 WHEN 'future' THEN 1 ELSE 2 END, ts)), '%Y-%m-%d %H:%M:%S') END AS published FROM s GROUP BY ALL",
    "quota_window": "WITH e AS (SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s, ts FROM events), c AS (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hour, count(*) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day, coalesce(s - lag(s) OVER (PARTITION BY event_type ORDER BY ts, event_id), 99999) AS gap FROM e) SELECT event_id, hour, day, CASE WHEN gap < 10 THEN 'cooldown' WHEN hour > 20 THEN 'hour_limit' WHEN day > 60 THEN 'day_limit' ELSE 'accepted' END AS verdict FROM c",
    "interleaved": "SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS place FROM events WHERE event_type IN ('error', 'purchase')",
    "superseded_jobs": "WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS article, o_orderkey % 7 AS version, CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'done' END AS state FROM orders) SELECT job_id, article, version, CASE WHEN state = 'queued' AND row_number() OVER (PARTITION BY article, state ORDER BY version DESC, job_id DESC) > 1 THEN 'superseded' ELSE state END AS state FROM j",
    "due_selection": "WITH w AS (SELECT event_id AS edge_id, ts, event_id % 5 = 0 AS retry, row_number() OVER (PARTITION BY event_id % 5 = 0 ORDER BY ts, event_id) AS n FROM events), t AS (SELECT *, CAST(CASE WHEN retry AND n <= 13 THEN 0 WHEN NOT retry THEN 1 ELSE 2 END AS INTEGER) AS tier FROM w WHERE n <= 40) SELECT edge_id, retry, tier FROM t ORDER BY tier, ts, edge_id LIMIT 40",
    "usage_summary": "SELECT count(*) AS calls, count(*) FILTER (event_id % 3 = 0) AS succeeded, CAST(sum(CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END) AS BIGINT) AS tokens_in, CAST(sum(user_id) AS BIGINT) AS tokens_out, round(avg(CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 60 AS DOUBLE) END), 6) AS mean_seconds FROM events",
    "slots": "SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) AS slot, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "editions": "WITH b AS (SELECT event_id, ts + INTERVAL 8 HOUR AS l FROM events), m AS (SELECT *, hour(l) * 60 + minute(l) AS m FROM b) SELECT event_id, CASE WHEN m >= 1230 THEN 'us_premarket' WHEN m >= 900 THEN 'close' WHEN m >= 570 THEN 'midday' ELSE 'morning' END AS edition, dayofweek(l) NOT IN (0, 6) AND CAST(l AS DATE) <> DATE '2024-01-01' AND (m >= 540 AND m < 720 OR m >= 840 AND m < 1080) AS peak FROM m",
}
