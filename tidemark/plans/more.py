"""Queries on alerts, option contracts, segments, briefings and payloads. Payloads are made from the tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..functions.rounding import nearest
from ..operators import alerts, briefing, options, performance, prices, segments
from ..sources import payloads
from ..sources.tables import table
from .common import shown
from .prices import _P as _PRICES
from .prices import _T as _TRENDS


def _market_days(spark, d):
    orders = table(spark, d, "orders", "o_orderdate", "o_orderpriority", "o_totalprice")
    bars = orders.groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("close"))
    s = prices.trend_state(prices.trend_summary(bars))
    n = F.datediff("day", F.lit("1995-01-01").cast("date"))
    strong, critical, fx = alerts.pressures((n * 7 % 40).cast("double"), (n * 3 % 7).cast("double"))
    return s.select(F.col("asset").alias("market"), "day", (n % 23 != 0).alias("valid"), "watch", "confirmed", "severe", strong.alias("strong"), critical.alias("critical"), fx.alias("fx"))


def market_alerts(spark, d):
    return shown(alerts.replay(_market_days(spark, d)))


def indicator_events(spark, d):
    e = table(spark, d, "events", "ts", "event_type", "event_id", "value")
    s = e.groupBy(F.col("event_type").alias("market"), F.to_date("ts").alias("day")).agg(F.max("value").alias("vix"), (F.count("*") % 7).cast("double").alias("stress"), (F.min("event_id") % 3 - 1).cast("double").alias("curve"), (F.max("event_id") % 5 + 100).cast("double").alias("dollar"))
    return shown(alerts.indicator_events(s))


def _contracts(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    k, bid = F.col("l_orderkey"), nearest(F.col("l_extendedprice") / 10_000, 2)
    return li.select(
        k.alias("contract"), "l_linenumber", (k % 75).alias("dte"), (-F.col("l_discount") * 4).alias("delta"), bid.alias("bid"), nearest(bid * (1 + F.col("l_tax")), 2).alias("ask"), (F.col("l_partkey") % 2000).alias("open_interest"),
        (F.col("l_suppkey") % 200).alias("volume"), F.when(k % 3 == 0, "realtime").when(k % 3 == 1, "delayed").otherwise("end_of_day").alias("mode"), (F.col("l_linenumber") * 4).alias("quote_age"),
        (k % 65).alias("account_age"), (k % 120).alias("earnings_in"), nearest(F.col("l_quantity") * 10, 2).alias("strike"), nearest(F.col("l_quantity") * 10.5, 2).alias("price"),
    )


def contract_gate(spark, d):
    found = options.evaluate(_contracts(spark, d))
    number = lambda c, n: nearest(F.col(c).cast("double"), n).alias(c)
    return found.select("contract", "l_linenumber", F.array_join("rejections", ",").alias("rejections"), number("reserve", 2), number("premium", 2), number("breakeven", 4), "cushion", "annualised")


def capacity(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    m = lambda x: x.cast("decimal(18,2)")
    key = F.col("c_custkey")
    a = c.select(
        key, m(F.abs("c_acctbal") * 10).alias("nlv"), m(F.abs("c_acctbal") * (key % 5)).alias("cash"), m(F.abs("c_acctbal") * 3).alias("buying_power"), m(key % 50 * 100).alias("existing"), m(key % 90 * 100 + 500).alias("ceiling"),
        (F.col("c_nationkey") * 100 + 333).alias("total_bps"), F.lit(250).alias("single_bps"), F.lit(777).alias("buffer_bps"), (key % 4).alias("weekly_left"),
    )
    found = options.capacity(a)
    return found.select("c_custkey", *[F.col(x).cast("double").alias(x) for x in ("total_limit", "single_limit", "buffer", "room", "effective", "remaining")], "abstain")


def _turns(spark, d):
    return table(spark, d, "conversations", "conv_id", "turn", "role", "text")


def segment_chunks(spark, d):
    return segments.chunks(_turns(spark, d).select(F.col("conv_id").alias("doc"), F.col("turn").alias("at"), "text"), 1500)


def oversize_parts(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), F.lit(0).alias("at"), "text")
    return segments.split_oversize(docs, 5000).select("doc", "part", F.length("text").alias("n"), F.md5("text").alias("digest"))


def transcript_checks(spark, d):
    at, doc = (F.col("conv_id") % 8) * 8 + F.col("turn"), F.floor(F.col("conv_id") / 8)
    back = F.when((doc % 5 == 0) & (at % 16 == 9), 30).otherwise(0)
    t = _turns(spark, d).select(doc.alias("doc"), at.alias("at"), (at * 7 - back).alias("start"), F.when(at % 3 == 0, at * 7 + 5).alias("end"), F.col("role").alias("speaker"), "text")
    return segments.validated(t)


def segment_ends(spark, d):
    t = _turns(spark, d).select(F.col("conv_id").alias("doc"), F.col("turn").alias("at"), (F.col("turn") - F.col("turn") % 2).alias("start"))
    return segments.with_ends(t)


def durations(spark, d):
    o = table(spark, d, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat_ws(":", k % 5, F.lpad((k % 60).cast("string"), 2, "0"), F.lpad((k % 59).cast("string"), 2, "0"))).when(k % 4 == 1, F.concat_ws(":", k % 70, F.lpad((k % 60).cast("string"), 2, "0"))).when(k % 4 == 2, (k % 1000).cast("string")).otherwise("soon")
    return o.select("o_orderkey", segments.duration(text).alias("seconds"))


def _items(spark, d):
    e, k = table(spark, d, "events", "event_id", "user_id", "event_type", "value"), F.col("event_id")
    return e.select(
        k.alias("item_id"), F.concat("event_type", F.lit("/"), F.col("user_id") % 5).alias("section"), F.when(k % 400 == 0, "critical").when(k % 45 == 0, "high").when(k % 5 == 0, "medium").otherwise("low").alias("impact"),
        F.when(k % 90 == 7, "official").when(k % 11 == 3, "first_party").when(k % 150 == 5, "reporting").otherwise("discovery").alias("tier"), (k % 13 == 0).alias("curated"), (k * 7 % 3000).alias("age_minutes"), F.col("value").alias("heat"),
    )


def briefing_sections(spark, d):
    return briefing.sections(_items(spark, d))


def briefing_highlights(spark, d):
    return briefing.highlights(_items(spark, d))


def chart_bars(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "event_type", "value")
    rows = e.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "value"))).alias("r"))
    result = F.struct(
        F.struct(F.upper("event_type").alias("symbol")).alias("meta"), F.col("r.t").alias("timestamp"), F.struct(
            F.array(F.struct(F.col("r.value").alias("close"), F.col("r.event_id").alias("volume"))).alias("quote"),
            F.array(F.struct(F.transform("r", lambda x: F.when(x["event_id"] % 2 == 0, x["value"] + 1)).alias("adjclose"))).alias("adjclose"),
        ).alias("indicators"),
    )
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    return payloads.chart_bars(rows.select(F.col("event_type").alias("source"), body.alias("body"))).select("symbol", F.unix_seconds("ts").alias("t"), "close", "volume")


def quote_lines(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name", "p_retailprice")
    symbol = F.concat(F.lit("sh"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    sent = F.when(F.col("p_partkey") % 10 == 0, "sz000001").otherwise(symbol)
    body = F.concat(F.lit("v_"), sent, F.lit('="1~'), "p_name", F.lit("~x~"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice").cast("string")).otherwise("-"), F.lit('~1.5"'))
    return payloads.quotes(p.select(symbol.alias("symbol"), body.alias("body")))


def last_complete_row(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_custkey")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("a"), F.when(F.col("o_custkey") % 3 == 1, F.col("o_custkey")).alias("b"))
    return payloads.last_complete(rows, "o_orderkey", ["a", "b"])


def csv_series(spark, d):
    o = table(spark, d, "orders", "o_orderdate", "o_totalprice", "o_orderpriority")
    points = o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).cast("decimal(18,2)").alias("v"))
    n = F.dayofmonth("day") % 4
    text = F.when(n == 0, F.date_format("day", "yyyy-MM-dd")).when(n == 1, F.date_format("day", "MM/dd/yyyy")).when(n == 2, F.date_format("day", "dd-MMM-yyyy")).otherwise(F.date_format("day", "yyyyMMdd"))
    return shown(payloads.series_csv(points.select("series", F.concat_ws(",", text, F.col("v").cast("string")).alias("line"))), 2)


def webvtt_cues(spark, d):
    """Conversations written as WebVTT and read again."""
    t = _turns(spark, d)
    at = lambda n: F.concat(F.lit("00:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(":05.500"))
    cue = F.concat(at(F.col("turn")), F.lit(" --> "), at(F.col("turn") + 1), F.lit(" align:start\n<v "), "role", F.lit(">"), F.regexp_replace("text", r"[^A-Za-z]+", " "))
    files = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("c"))
    body = F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.col("c.cue"), "\n\n"))
    return payloads.webvtt(files.select(F.col("conv_id").alias("doc"), body.alias("body"))).select("doc", "at", "start", "end", "speaker", "text")


def rank_lists(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_retailprice", "p_size")
    # A list that is served has its first 40 alone.
    first = lambda key: p.select(key.alias("k"), "p_partkey").orderBy("k", "p_partkey").limit(40)
    by = lambda name, key: first(key).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p_partkey"))), lambda x: x["p_partkey"]).alias("ids")).select(F.lit(name).alias("name"), "ids")
    return payloads.ranked_lists(by("top", -F.col("p_retailprice")).unionByName(by("best", -F.col("p_size").cast("double"))))


def feed_rows(spark, d):
    """Pages written as an RSS item each and read again."""
    p = table(spark, d, "pages", "page_id", "url")
    body = F.concat(F.lit("<rss><channel><item><title>Page "), "page_id", F.lit("</title><link>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</link><pubDate>Wed, 03 Jan 2024 10:00:00 +0800</pubDate></item><item><title></title></item></channel></rss>"))
    rows = payloads.feed_items(p.select(F.col("page_id").cast("string").alias("source"), body.alias("body")))
    return rows.select("source", "title", "url", F.date_format(payloads.feed_time(F.col("published")), "yyyy-MM-dd HH:mm").alias("published"))


def holdings_rows(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_name")
    line = F.when(F.col("c_custkey") % 9 == 0, "| --- | --- |").when(F.col("c_custkey") % 9 == 1, "plain text").otherwise(F.concat(F.lit("| us:"), "c_name", F.lit(" | 1,"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(" | note |")))
    return payloads.holdings(c.select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("at"), line.alias("line"))).select("doc", "at", "asset", F.col("quantity").cast("double").alias("quantity"))


def relative_times(spark, d):
    e = table(spark, d, "events", "event_id", "ts")
    k = F.col("event_id")
    label = F.when(k % 5 == 0, F.concat(k % 70, F.lit("m"))).when(k % 5 == 1, F.concat(k % 30, F.lit(" H "))).when(k % 5 == 2, F.concat(k % 90, F.lit("s"))).when(k % 5 == 3, "Aug 4").otherwise("5 minutes ago")
    return e.select("event_id", F.unix_seconds(times.relative(label, F.col("ts"))).alias("t"))


def url_stamps(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    stamp = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("0930157"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("a_"), day, F.lit("093015"))).otherwise("20191399999999")
    return o.select("o_orderkey", F.unix_seconds(times.url_stamp(F.concat(F.lit("https://x.cn/"), stamp, F.lit("/index.html")))).alias("t"))


def drawdown_path(spark, d):
    orders = table(spark, d, "orders", "o_orderdate", "o_orderpriority", "o_totalprice")
    points = orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("value"))
    return shown(performance.drawdowns(points).select("series", "day", "drawdown", "peak_day"))


QUERIES = {
    f.__name__: f
    for f in (
        market_alerts, indicator_events, contract_gate, capacity, segment_chunks, oversize_parts, transcript_checks, segment_ends, durations, briefing_sections, briefing_highlights, chart_bars, quote_lines,
        last_complete_row, csv_series, webvtt_cues, rank_lists, feed_rows, holdings_rows, relative_times, url_stamps, drawdown_path,
    )
}
_ITEMS = """i AS (SELECT event_id AS item_id, event_type || '/' || (user_id % 5) AS section, CASE WHEN event_id % 400 = 0 THEN 4 WHEN event_id % 45 = 0 THEN 3 WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS impact,
  CASE WHEN event_id % 90 = 7 THEN 'official' WHEN event_id % 11 = 3 THEN 'first_party' WHEN event_id % 150 = 5 THEN 'reporting' ELSE 'discovery' END AS tier, event_id % 13 = 0 AS curated, event_id * 7 % 3000 AS age, value AS heat FROM events),
k AS (SELECT *, CASE tier WHEN 'official' THEN 3 WHEN 'first_party' THEN 3 WHEN 'reporting' THEN 1 ELSE 0 END AS tr FROM i),
c AS (SELECT *, CASE WHEN age <= 90 AND tr >= 1 THEN 0 WHEN curated AND age <= 1440 THEN 1 WHEN tr >= 1 THEN 2 WHEN age <= 90 THEN 3 ELSE 4 END AS kind FROM k),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY impact DESC, kind, tr DESC, heat DESC, age, item_id) AS INTEGER) AS place FROM c)"""
_CODES = [
    ("dte_too_short", "dte < 21"), ("dte_too_long", "dte > 60"), ("delta_not_negative", "delta >= 0"), ("delta_too_small", "abs(delta) < 0.10::DOUBLE"), ("delta_too_large", "abs(delta) > 0.30::DOUBLE"), ("bid_not_positive", "bid <= 0"), ("ask_below_bid", "ask < bid"),
    ("spread_too_wide", "bid > 0 AND ask - bid > bid * 0.08::DOUBLE"), ("open_interest_too_low", "oi < 500"), ("volume_too_low", "vol < 50"), ("quote_stale", "qa > CASE WHEN k % 3 = 0 THEN 15 WHEN k % 3 = 1 THEN 1800 ELSE 345600 END"),
    ("account_stale", "k % 65 > 60"), ("earnings_before_expiry", "k % 120 <= dte"),
]
SQL = {
    "market_alerts": rf"""WITH RECURSIVE {_PRICES}, {_TRENDS},
d AS (
  SELECT asset AS market, day, date_diff('day', DATE '1995-01-01', day) AS k, close < sma_short OR sma_short - earlier < 0 AS watch, close < sma_short AND sma_short - earlier < 0 AS confirmed,
         close < sma_long AND sma_short < sma_long AND drawdown <= -0.10 AS severe FROM t WHERE n >= 60),
v AS (
  SELECT market, day, row_number() OVER (PARTITION BY market ORDER BY day) AS n, k % 23 <> 0 AS valid, watch, confirmed AND strong > 0 AS raw_reduce, severe AND critical >= 2 AS raw_exit, strong
  FROM (SELECT *, CAST(k * 7 % 40 >= 28 AS INTEGER) + CAST(k * 3 % 7 > 2 AS INTEGER) AS strong, CAST(k * 7 % 40 >= 35 AS INTEGER) + CAST(k * 3 % 7 > 5 AS INTEGER) AS critical FROM d)),
r AS (
  SELECT DISTINCT market, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS day, true AS valid, 0 AS action, 0 AS reduce_n, 0 AS exit_n, 0 AS recovery_n, false AS pending FROM v
  UNION ALL
  SELECT market, n, day, valid, CASE WHEN NOT valid THEN 0 WHEN held THEN before ELSE wanted END, CASE WHEN valid THEN reduce_n ELSE 0 END, CASE WHEN valid THEN exit_n ELSE 0 END,
         CASE WHEN valid AND before > wanted AND NOT active THEN recovery_n + 1 ELSE 0 END, valid AND held AND NOT active
  FROM (SELECT *, before > wanted AND (active OR recovery_n + 1 < 2) AS held
        FROM (SELECT *, (before = 2 AND (raw_reduce OR raw_exit)) OR (before = 3 AND raw_exit) AS active,
                     CASE WHEN exit_n >= 2 AND before >= 2 THEN 3 WHEN reduce_n >= 2 THEN 2 WHEN raw_reduce OR raw_exit OR watch OR strong > 0 THEN 1 ELSE 0 END AS wanted
              FROM (SELECT v.*, r.action AS before, CASE WHEN v.raw_reduce OR v.raw_exit THEN least(r.reduce_n + 1, 3) ELSE 0 END AS reduce_n, CASE WHEN v.raw_exit THEN least(r.exit_n + 1, 3) ELSE 0 END AS exit_n, r.recovery_n
                    FROM r JOIN v ON v.market = r.market AND v.n = r.n + 1))))
SELECT market, CAST(day AS VARCHAR) AS day, ['observe', 'prepare_reduce', 'reduce_candidate', 'exit_candidate'][action + 1] AS action, CASE WHEN valid THEN ['low', 'medium', 'high', 'critical'][action + 1] ELSE 'insufficient' END AS level, pending
FROM r WHERE n > 0""",
    "indicator_events": """WITH s AS (SELECT event_type AS market, CAST(ts AS DATE) AS day, max(value) AS vix, CAST(count(*) % 7 AS DOUBLE) AS stress, CAST(min(event_id) % 3 - 1 AS DOUBLE) AS curve, CAST(max(event_id) % 5 + 100 AS DOUBLE) AS dollar FROM events GROUP BY 1, 2),
p AS (SELECT *, lag(vix) OVER w AS pv, lag(stress) OVER w AS ps, lag(curve) OVER w AS pc, lag(dollar) OVER w AS pd FROM s WINDOW w AS (PARTITION BY market ORDER BY day))
SELECT market, CAST(day AS VARCHAR) AS day, 'vix' AS kind, round(vix, 6) AS value FROM p WHERE abs(vix - pv) >= 3 OR (pv < 25 AND vix >= 25)
UNION ALL SELECT market, CAST(day AS VARCHAR), 'stress', stress FROM p WHERE abs(stress - ps) >= 1 OR (ps < 0) <> (stress < 0) OR (ps < 2) <> (stress < 2) OR (ps < 5) <> (stress < 5)
UNION ALL SELECT market, CAST(day AS VARCHAR), 'curve', curve FROM p WHERE sign(pc) * sign(curve) < 0
UNION ALL SELECT market, CAST(day AS VARCHAR), 'dollar', dollar FROM p WHERE abs(dollar / pd - 1) >= 0.01::DOUBLE""",
    "contract_gate": f"""WITH x AS (SELECT l_orderkey AS k, l_linenumber, l_orderkey % 75 AS dte, -l_discount * 4 AS delta, round(l_extendedprice / 10000, 2) AS bid, l_tax, l_partkey % 2000 AS oi, l_suppkey % 200 AS vol, l_linenumber * 4 AS qa, round(l_quantity * 10, 2) AS strike, round(l_quantity * 10.5::DOUBLE, 2) AS price FROM lineitem),
y AS (SELECT *, round(bid * (1 + l_tax), 2) AS ask FROM x), z AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in _CODES)}], lambda v: v IS NOT NULL) AS r FROM y),
n AS (SELECT *, len(r) = 0 AS ok, CAST(CAST(strike AS DECIMAL(18,4)) - CAST(bid AS DECIMAL(18,4)) AS DOUBLE) AS be FROM z)
SELECT k AS contract, l_linenumber, array_to_string(r, ',') AS rejections, CASE WHEN ok THEN round(strike * 100, 2) END AS reserve, CASE WHEN ok THEN round(bid * 100, 2) END AS premium, CASE WHEN ok THEN round(be, 4) END AS breakeven,
  CASE WHEN ok THEN (price - be) / price END AS cushion, CASE WHEN ok THEN bid / strike * 365 / dte END AS annualised FROM n""",
    "capacity": """WITH a AS (SELECT c_custkey, CAST(abs(c_acctbal) * 10 AS DECIMAL(18,2)) AS nlv, CAST(abs(c_acctbal) * (c_custkey % 5) AS DECIMAL(18,2)) AS cash, CAST(abs(c_acctbal) * 3 AS DECIMAL(18,2)) AS bp, CAST(c_custkey % 50 * 100 AS DECIMAL(18,2)) AS existing,
  CAST(c_custkey % 90 * 100 + 500 AS DECIMAL(18,2)) AS ceiling, c_nationkey * 100 + 333 AS tb, c_custkey % 4 AS wl FROM customer),
i AS (SELECT *, CAST(nlv * 100 AS BIGINT) AS n FROM a),
b AS (SELECT *, CAST((n * tb // 10000) / 100.0 AS DECIMAL(18,2)) AS tl, CAST((n * 250 // 10000) / 100.0 AS DECIMAL(18,2)) AS sl, CAST(((n * 777 + 9999) // 10000) / 100.0 AS DECIMAL(18,2)) AS buf FROM i),
c AS (SELECT *, greatest(0, least(bp, cash - buf)) AS room FROM b), e AS (SELECT *, least(ceiling, tl, existing + room) AS eff FROM c)
SELECT c_custkey, CAST(tl AS DOUBLE) AS total_limit, CAST(sl AS DOUBLE) AS single_limit, CAST(buf AS DOUBLE) AS buffer, CAST(room AS DOUBLE) AS room, CAST(eff AS DOUBLE) AS effective, CAST(eff - existing AS DOUBLE) AS remaining,
  CASE WHEN cash < buf THEN 'cash_buffer_breached' WHEN existing > least(ceiling, tl) THEN 'existing_collateral_limit_breached' WHEN wl <= 0 THEN 'weekly_new_contract_limit_reached' WHEN eff <= existing THEN 'new_capacity_unavailable' END AS abstain FROM e""",
    "segment_chunks": """WITH RECURSIVE q AS (SELECT conv_id, turn, length(text) AS whole, unnest(range(0, length(text), 1500)) AS a FROM conversations WHERE length(text) > 0),
s AS (SELECT conv_id, turn, a // 1500 AS part, least(1500, whole - a) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, a) AS k FROM q),
r AS (SELECT conv_id, turn, part, k, 0 AS chunk, n AS used FROM s WHERE k = 1
  UNION ALL SELECT s.conv_id, s.turn, s.part, s.k, CASE WHEN r.used > 0 AND r.used + s.n > 1500 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used > 0 AND r.used + s.n > 1500 THEN s.n ELSE r.used + s.n END FROM r JOIN s ON s.conv_id = r.conv_id AND s.k = r.k + 1)
SELECT conv_id AS doc, turn AS at, CAST(part AS INTEGER) AS part, CAST(chunk AS INTEGER) AS chunk FROM r""",
    "oversize_parts": "SELECT doc_id AS doc, CAST(p AS INTEGER) AS part, CAST(length(substr(text, p * 5000 + 1, 5000)) AS INTEGER) AS n, md5(substr(text, p * 5000 + 1, 5000)) AS digest FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 5000) AS BIGINT)))) AS p FROM documents)",
    "transcript_checks": """WITH t AS (SELECT conv_id // 8 AS doc, (conv_id % 8) * 8 + turn AS "at", role, text FROM conversations),
u AS (SELECT *, "at" * 7 - CASE WHEN doc % 5 = 0 AND "at" % 16 = 9 THEN 30 ELSE 0 END AS start, CASE WHEN "at" % 3 = 0 THEN "at" * 7 + 5 END AS stop FROM t),
l AS (SELECT *, coalesce(start >= lag(start) OVER (PARTITION BY doc ORDER BY "at"), true) AND trim(text) <> '' AND coalesce(stop > start, true) AS ok, count(*) OVER (PARTITION BY doc, role) AS turns FROM u)
SELECT doc, count(*) AS segments, count(DISTINCT role) AS speakers, max(start) - min(start) AS seconds,
  bool_and(coalesce(ok, false)) AND count(*) >= 20 AND sum(length(text)) >= 2000 AND max(start) - min(start) >= 60 AND count(DISTINCT role) <= 12 AND max(turns) >= 3 AS valid FROM l GROUP BY doc""",
    "segment_ends": "WITH t AS (SELECT conv_id AS doc, turn AS \"at\", turn - turn % 2 AS start FROM conversations) SELECT doc, \"at\", start, (SELECT min(u.start) FROM t u WHERE u.doc = t.doc AND u.start > t.start) AS \"end\" FROM t",
    "durations": "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 5) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59 WHEN 1 THEN (o_orderkey % 70) * 60 + o_orderkey % 60 WHEN 2 THEN o_orderkey % 1000 END AS BIGINT) AS seconds FROM orders",
    "briefing_sections": f"""WITH {_ITEMS}, b AS (SELECT section, min(place) FILTER (tier = 'reporting') AS bp, bool_or(tier = 'reporting') FILTER (place <= 6) AS has, max(place) FILTER (place <= 6 AND impact < 3 AND tr < 3) AS weak FROM r GROUP BY 1),
j AS (SELECT r.*, bp, weak, NOT has AND weak IS NOT NULL AND bp IS NOT NULL AS swaps FROM r JOIN b USING (section))
SELECT section, item_id, CASE WHEN swaps AND place = bp THEN weak ELSE place END AS place FROM j WHERE (place <= 6 AND NOT (swaps AND place = weak)) OR (swaps AND place = bp)""",
    "briefing_highlights": f"""WITH {_ITEMS}, m AS (SELECT *, max(CASE WHEN impact = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY section) AS major FROM r), h AS (SELECT *, CASE WHEN impact = 4 THEN 0 WHEN major = 0 AND place = 1 THEN 1 ELSE 2 END AS choice FROM m)
SELECT item_id, section, CAST(choice AS INTEGER) AS choice FROM h ORDER BY choice, impact DESC, kind, heat DESC, item_id LIMIT 5""",
    "chart_bars": "SELECT upper(event_type) AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE WHEN event_id % 2 = 0 THEN value + 1 ELSE value END AS close, event_id AS volume FROM events WHERE CASE WHEN event_id % 2 = 0 THEN value + 1 ELSE value END > 0",
    "quote_lines": "SELECT 'sh' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS symbol, p_name AS name, p_retailprice AS price, 1.5::DOUBLE AS previous FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 > 0",
    "last_complete_row": "SELECT o_orderkey, o_totalprice AS a, o_custkey AS b FROM orders WHERE o_orderkey % 9 <> 0 AND o_custkey % 3 = 1 ORDER BY o_orderkey DESC LIMIT 1",
    "csv_series": "SELECT o_orderpriority AS series, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2",
    "webvtt_cues": r"""SELECT conv_id AS doc, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS at, CAST(turn % 60 * 60 + 5.5 AS DOUBLE) AS start, CAST((turn + 1) % 60 * 60 + 5.5 AS DOUBLE) AS "end", role AS speaker,
  trim(regexp_replace(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM conversations""",
    "rank_lists": """WITH p AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY -p_retailprice, p_partkey) AS t, row_number() OVER (ORDER BY -p_size, p_partkey) AS b FROM part)
SELECT id, CAST(least(CASE WHEN t <= 40 THEN t END, CASE WHEN b <= 40 THEN b END) AS INTEGER) AS rank, CAST(CASE WHEN t <= 40 THEN t END AS INTEGER) AS top_rank, CAST(CASE WHEN b <= 40 THEN b END AS INTEGER) AS best_rank FROM p WHERE t <= 40 OR b <= 40""",
    "feed_rows": "SELECT CAST(page_id AS VARCHAR) AS source, 'Page ' || page_id AS title, url, '2024-01-03 02:00' AS published FROM pages",
    "holdings_rows": "SELECT c_nationkey AS doc, c_custkey AS at, upper('us:' || c_name) AS asset, CAST(1000 + c_custkey % 1000 AS DOUBLE) AS quantity FROM customer WHERE c_custkey % 9 > 1",
    "relative_times": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 70 <= 59 THEN (event_id % 70 + 1) * 60 END WHEN 1 THEN CASE WHEN event_id % 30 <= 23 THEN (event_id % 30 + 1) * 3600 END WHEN 2 THEN CASE WHEN event_id % 90 <= 59 THEN event_id % 90 + 1 END END AS t FROM events",
    "url_stamps": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + 34215 - 28800 END AS BIGINT) AS t FROM orders",
    "drawdown_path": """WITH p AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)
SELECT series, CAST(day AS VARCHAR) AS day, round(value / max(value) OVER w - 1, 6) AS drawdown, CAST(arg_max(day, (value, -date_diff('day', DATE '1970-01-01', day))) OVER w AS VARCHAR) AS peak_day FROM p WINDOW w AS (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING)""",
}
