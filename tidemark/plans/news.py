"""Queries on news, signals, coverage, anchors and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, signals
from ..operators import news, store
from ..sources.tables import table
from .common import shown
from .text import _A, _B, _any, _hits, _list, _word

_NOW = "2024-01-31 12:00:00"
#: Ways to write an asset and the key of each.
_KEYS = (
    ("aapl", "US:AAPL"), ("HK:700", None), ("toolong7", None), ("brk.b", "US:BRK.B"), ("SH:600519", "CN:600519"), ("000001.sz", "CN:000001"), ("$X", "US:X"), ("usd/cny", "FX:USD/CNY"), ("(btc)", "CRYPTO:BTC"), ("crypto: doge", "CRYPTO:DOGE"),
)


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


def _events(spark, d):
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")


def _texts(spark, d):
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % n).cast("int"))
    asset = F.get(F.array(F.lit("gold and bitcoin"), F.lit("$AAPL"), F.lit("code 600519 now"), F.lit("nothing"), F.lit("NVDA and THE CEO")), (F.col("event_id") % 5).cast("int"))
    return _events(spark, d).withColumn("head", pick(_A, len(_A))).withColumn("text", F.concat_ws(" ", "head", asset, pick(_B, len(_B))))


def news_snapshot(spark, d):
    e = _events(spark, d)
    items = e.select((F.col("event_id") % 2000).alias("item_id"), F.col("ts"), F.col("event_id")).groupBy("item_id").agg(F.max(F.when(F.col("event_id") % 3 > 0, F.col("ts"))).alias("published"), F.min("ts").alias("first_seen"))
    bridge = e.select((F.col("event_id") % 2000).alias("item_id"), F.col("event_type").alias("source"))
    return news.snapshot(items, bridge, _now()).select("item_id", "sources", "n_sources", F.date_format("shown_at", "yyyy-MM-dd HH:mm:ss").alias("shown_at"))


def news_catalogue(spark, d):
    instruments = table(spark, d, "part", "p_partkey").select(F.concat(F.lit("i"), F.col("p_partkey") % 300).alias("instrument")).distinct()
    items = _events(spark, d).select(F.concat(F.lit("i"), F.col("user_id") * 2).alias("instrument"), F.when(F.col("event_type") == "view", "related").otherwise("direct").alias("kind"))
    return news.catalogue(instruments, items)


def data_coverage(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_custkey")
    rows = o.select(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("a"), F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey")).alias("b"), "o_orderkey")
    return news.coverage(rows, ["a", "b", "o_orderkey"])


def reason_histogram(spark, d):
    r = _events(spark, d).select(F.when(F.col("event_id") % 5 < 2, F.concat(F.lit("reason_"), F.col("event_id") % 5 + F.col("user_id") % 3)).alias("reason"), F.col("event_type").alias("asset"))
    return news.reason_histogram(r)


def score_anchors(spark, d):
    return news.anchors(_events(spark, d).select(F.col("user_id").alias("series"), "ts", "value"))


def window_states(spark, d):
    e = _events(spark, d)
    edges = e.select(F.col("event_id").alias("edge_id"), F.col("ts").alias("event_ts"))
    stored = e.where("event_id % 2 = 0").select(F.col("event_id").alias("edge_id"), F.explode(F.array(F.lit(1), F.lit(3))).alias("window"), F.when(F.col("event_id") % 4 == 0, "complete").when(F.col("event_id") % 6 == 0, "unavailable").otherwise("pending").alias("status"))
    return news.window_states(edges, stored, _now()).select("edge_id", "window", "state")


def best_reactions(spark, d):
    s = _events(spark, d).select((F.col("user_id") % 40).alias("source"), "event_type", F.when(F.col("event_id") % 9 == 0, "complete").when(F.col("event_id") % 3 == 0, "preliminary").otherwise("pending").alias("status"), F.col("ts").alias("observed_at"), F.col("event_id").alias("row_id"))
    return news.best_by_window(s, ["source", "event_type"], store.status_rank(F.col("status")))


def merged_feeds(spark, d):
    e = _events(spark, d).select("event_id", "value")
    return news.merged_feeds(e.where("value > 15"), e.where("event_id % 3 = 0"), "event_id")


def private_overlay(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    cards = table(spark, d, "nation", "n_nationkey").select(F.col("n_nationkey").alias("card_id"), F.col("n_nationkey").alias("asset"), (F.lit(0.5) + F.col("n_nationkey") * 0.01).alias("confidence"))
    positions = c.where("c_nationkey % 4 < 3").select(F.col("c_nationkey").alias("asset"), (F.col("c_custkey") % 100).alias("quantity"), F.when((F.col("c_nationkey") % 5 == 0) & (F.col("c_custkey") % 2 == 0), "CNY").otherwise("USD").alias("currency"), (F.col("c_custkey") % 800 == 1).alias("stale"))
    quotes = c.groupBy(F.col("c_nationkey").alias("asset")).agg(F.round(F.max("c_acctbal"), 2).alias("price"), (F.count("*") < 2).alias("quote_stale"))
    return news.overlay(cards, positions, quotes)


def event_edges(spark, d):
    e = _texts(spark, d).withColumn("tickers", F.when(F.col("event_id") % 7 == 0, F.array(F.lit("msft"), F.lit("cn:x"), F.lit("bad key!"))).otherwise(F.array().cast("array<string>")))
    impact = F.when(F.col("value") > 60, "high").when(F.col("value") > 20, "medium").otherwise("low")
    return news.event_edges(e.withColumn("impact", impact))


def text_tickers(spark, d):
    named = F.concat(F.upper(F.regexp_extract("source", "[a-z]+", 0)), F.lit(" class B stock, THE shares of AI stock"))
    text = F.concat_ws(" ", "text", F.concat(F.lit("buy $"), F.upper("lang")), named)
    return table(spark, d, "documents", "doc_id", "text", "lang", "source").select("doc_id", F.array_join(signals.tickers(text), ",").alias("tickers"))


def asset_keys(spark, d):
    k = F.col("p_partkey")
    v = F.when(k % 12 == 0, F.concat(F.lit(" us:"), k)).when(k % 12 == 1, F.lpad(k.cast("string"), 6, "0")).otherwise(F.get(F.array(*[F.lit(name) for name, _ in _KEYS]), (k % 12 - 2).cast("int")))
    return table(spark, d, "part", "p_partkey").select("p_partkey", signals.asset_key(v).alias("asset"))


def signal_scores(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    score = signals.signal_score(F.col("l_quantity") * 2, F.col("l_discount") * 1000, F.col("l_tax") * 1250, F.col("l_linenumber") * 14, F.col("l_orderkey") % 101)
    return li.select("l_orderkey", "l_linenumber", score.alias("score")).withColumn("level", signals.signal_level(F.col("score")))


def input_hashes(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    brand = F.when(F.col("p_partkey") % 6 > 0, F.col("p_brand"))
    return p.select("p_partkey", signals.input_hash([brand.alias("brand"), F.col("p_size").alias("size")]).alias("hash"))


def merged_references(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "role")
    refs = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"] % 3)).alias("refs"))
    return news.merge_material(refs.withColumnRenamed("conv_id", "doc"))


def reference_checks(spark, d):
    o = table(spark, d, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    bad = news.unknown_references(F.array(k % 5, k % 7, k % 3), F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
    return o.select("o_orderkey", F.array_join(bad.cast("array<string>"), ",").alias("unknown"))


def carried_stress(spark, d):
    o = table(spark, d, "orders", "o_orderdate", "o_orderpriority", "o_totalprice", "o_orderkey")
    p = o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.max(F.when(F.col("o_orderkey") % 40 == 0, F.col("o_totalprice"))).alias("value"))
    return shown(news.last_stress(p), 2)


def price_scan(spark, d):
    e = _events(spark, d).where((F.col("event_type") == "view") & F.col("ts").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")))
    return e.orderBy("ts", "event_id").limit(1000).select("event_id", "value")


def labelled_confirmation(spark, d):
    """Whether the direction seen agrees with the one expected, abstaining where either says nothing."""
    from ..operators.prices import confirmation

    up = F.when(F.col("event_id") % 3 == 0, "up").when(F.col("event_id") % 3 == 1, "down").otherwise("flat")
    want = F.when(F.col("user_id") % 2 == 0, "up").otherwise("down")
    return _events(spark, d).select("event_id", confirmation(up, want).alias("confirmed"), rules.risk_level(F.col("value")).alias("level"))


QUERIES = {
    f.__name__: f
    for f in (
        news_snapshot, news_catalogue, data_coverage, reason_histogram, score_anchors, window_states, best_reactions, merged_feeds, private_overlay, event_edges, text_tickers, asset_keys, signal_scores, input_hashes, merged_references, reference_checks, carried_stress, price_scan, labelled_confirmation,
    )
}
_T = f"x AS (SELECT *, {_list(_A)}[event_id % {len(_A)} + 1] || ' ' || ['gold and bitcoin', '$AAPL', 'code 600519 now', 'nothing', 'NVDA and THE CEO'][event_id % 5 + 1] || ' ' || {_list(_B)}[event_id % {len(_B)} + 1] AS text FROM events)"


def _has(column: str, words) -> str:
    return _word(words).replace("lower(t)", f"lower({column})")


def _named(column: str) -> str:
    return "[" + ", ".join(f"CASE WHEN {_any(names, column)} THEN '{key}' END" for key, names in signals.ALIASES) + "]"


_TOPIC = "CASE " + " ".join(f"WHEN {_any(w, 'text')} THEN '{name}'" for name, w in rules.TOPICS) + " ELSE 'general' END"


_EDGES = f"""a AS (SELECT *, {_TOPIC} AS topic, {_hits(rules.POSITIVE, "text")} AS good, {_hits(rules.NEGATIVE, "text")} AS bad,
  list_filter(list_concat(CASE WHEN event_id % 7 = 0 THEN ['US:MSFT', 'CN:X'] ELSE [] END, CASE WHEN event_id % 5 = 1 THEN ['US:AAPL'] ELSE [] END, CASE WHEN event_id % 5 = 2 THEN ['CN:600519'] ELSE [] END, {_named("text")}), lambda v: v IS NOT NULL) AS assets FROM x),
s AS (SELECT *, CASE WHEN good > bad THEN 'bullish' WHEN bad > good THEN 'bearish' ELSE 'unknown' END AS stance FROM a),
e AS (SELECT *, unnest(CASE WHEN len(assets) = 0 THEN [NULL] ELSE assets END) AS asset FROM s),
c AS (SELECT *, least(0.30::DOUBLE + CASE WHEN asset IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN stance <> 'unknown' THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN topic <> 'general' THEN 0.10::DOUBLE ELSE 0 END + 0.05::DOUBLE, 0.95) AS c FROM e)"""
SQL = {
    "news_snapshot": """WITH i AS (SELECT event_id % 2000 AS item_id, max(ts) FILTER (event_id % 3 > 0) AS p, min(ts) AS f FROM events GROUP BY 1), b AS (SELECT event_id % 2000 AS item_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources, count(DISTINCT event_type) AS n_sources FROM events GROUP BY 1)
SELECT item_id, sources, n_sources, strftime(coalesce(p, f), '%Y-%m-%d %H:%M:%S') AS shown_at FROM i JOIN b USING (item_id) WHERE coalesce(p, f) BETWEEN TIMESTAMP '2024-01-24 12:00:00' AND TIMESTAMP '2024-01-31 12:00:00'""",
    "news_catalogue": "WITH i AS (SELECT DISTINCT 'i' || (p_partkey % 300) AS instrument FROM part), n AS (SELECT 'i' || (user_id * 2) AS instrument, event_type FROM events) SELECT instrument, count(event_type) FILTER (event_type <> 'view') AS direct, count(event_type) FILTER (event_type = 'view') AS related FROM i LEFT JOIN n USING (instrument) GROUP BY 1",
    "data_coverage": "SELECT a AS available, t AS total, round(100 * a / t, 1) AS pct FROM (SELECT count(*) FILTER (o_orderkey % 4 > 0) + count(*) FILTER (o_custkey % 7 > 0) + count(*) AS a, 3 * count(*) AS t FROM orders)",
    "reason_histogram": "SELECT 'reason_' || (event_id % 5 + user_id % 3) AS reason, count(*) AS n, count(DISTINCT event_type) AS assets FROM events WHERE event_id % 5 < 2 GROUP BY 1",
    "score_anchors": """WITH l AS (SELECT user_id AS series, max(ts) AS lt, arg_max(value, ts) AS last_value FROM events GROUP BY 1), j AS (SELECT series, lt, last_value, ts, value, lt - INTERVAL 24 HOUR AS tg FROM events JOIN l ON user_id = series WHERE ts < lt)
SELECT series, last_value, arg_max(value, ts) FILTER (ts <= tg) AS value_before, arg_min(value, (abs(epoch_us(ts) - epoch_us(tg)), ts)) AS value_nearest FROM j GROUP BY series, last_value""",
    "window_states": """SELECT event_id AS edge_id, CAST(w AS INTEGER) AS "window", CASE WHEN st = 'complete' THEN 'done' WHEN ts + INTERVAL 1 DAY * w > TIMESTAMP '2024-01-31 12:00:00' THEN 'not_due' WHEN st = 'unavailable' THEN 'retry' ELSE 'due' END AS state
FROM (SELECT event_id, ts, w, CASE WHEN event_id % 2 = 0 AND w < 5 THEN CASE WHEN event_id % 4 = 0 THEN 'complete' WHEN event_id % 6 = 0 THEN 'unavailable' ELSE 'pending' END END AS st FROM events, (VALUES (1), (3), (5)) v(w))""",
    "best_reactions": "WITH s AS (SELECT user_id % 40 AS source, event_type, event_id, ts, CASE WHEN event_id % 9 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS r FROM events) SELECT source, event_type, event_id AS row_id, ['pending', 'preliminary', 'complete'][r] AS status FROM s QUALIFY row_number() OVER (PARTITION BY source, event_type ORDER BY r DESC, ts DESC, event_id DESC) = 1",
    "merged_feeds": "SELECT event_id, value, CASE WHEN value > 15 THEN 'priority' ELSE 'regular' END AS feed FROM events WHERE value > 15 OR event_id % 3 = 0",
    "private_overlay": """WITH h AS (SELECT c_nationkey AS asset, sum(c_custkey % 100) AS quantity, count(*) AS positions, count(DISTINCT CASE WHEN c_nationkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'CNY' ELSE 'USD' END) AS cur, bool_or(c_custkey % 800 = 1) AS ps FROM customer WHERE c_nationkey % 4 < 3 GROUP BY 1),
q AS (SELECT c_nationkey AS asset, round(max(c_acctbal), 2) AS price, count(*) < 2 AS qs FROM customer GROUP BY 1)
SELECT n_nationkey AS card_id, n_nationkey AS asset, coalesce(positions, 0) AS positions, CASE WHEN cur = 1 AND NOT coalesce(qs, true) THEN round(price * quantity, 2) END AS exposure,
  round((0.5::DOUBLE + n_nationkey * 0.01::DOUBLE) * (CASE WHEN coalesce(ps, false) THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN coalesce(qs, true) THEN 0.75::DOUBLE ELSE 1 END), 4) AS confidence FROM nation LEFT JOIN h ON h.asset = n_nationkey LEFT JOIN q ON q.asset = n_nationkey""",
    "event_edges": f"""WITH {_T}, {_EDGES} SELECT event_id, topic, asset, CASE stance WHEN 'unknown' THEN 'neutral' ELSE stance END AS direction, round(CASE WHEN stance = 'unknown' THEN least(c, 0.45) ELSE c END, 2) AS confidence,
  round(least(0.30::DOUBLE + CASE WHEN value > 60 THEN 0.30::DOUBLE WHEN value > 20 THEN 0.15 ELSE 0.05 END + CASE WHEN stance <> 'unknown' THEN 0.15::DOUBLE ELSE 0 END, 1.0), 2) AS strength FROM c""",
    "text_tickers": rf"""WITH x AS (SELECT doc_id, concat_ws(' ', text, 'buy $' || upper(lang), upper(regexp_extract(source, '[a-z]+', 0)) || ' class B stock, THE shares of AI stock') AS t FROM documents),
f AS (SELECT doc_id, list_transform(list_filter(list_transform(regexp_extract_all(t, '({signals.TICKER})', 1), lambda m: regexp_extract(m, '^(\$?[A-Z][A-Z0-9.-]{{0,5}})', 1)), lambda w: NOT list_contains({_list(signals.STOP_TICKERS)}, w)), lambda w: replace(w, '$', '')) AS f FROM x)
SELECT doc_id, array_to_string(list_filter(f, lambda w, i: list_position(f, w) = i)[1:8], ',') AS tickers FROM f""",
    "asset_keys": "SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'US:' || p_partkey WHEN 1 THEN 'CN:' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') " + " ".join(f"WHEN {i} THEN '{key}'" for i, (_, key) in enumerate(_KEYS, 2) if key) + " END AS asset FROM part",
    "signal_scores": """SELECT *, CASE WHEN score >= 85 THEN 'CRITICAL' WHEN score >= 70 THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT l_orderkey, l_linenumber,
  floor((round(10000.0::DOUBLE * (l_quantity * 2 * 0.35::DOUBLE + l_discount * 1000 * 0.25::DOUBLE + l_tax * 1250 * 0.20::DOUBLE + (l_linenumber * 14)::DOUBLE * 0.10::DOUBLE + (l_orderkey % 101)::DOUBLE * 0.10::DOUBLE)) + 500) / 1000) / 10 AS score FROM lineitem)""",
    "input_hashes": "SELECT p_partkey, sha256('{\"brand\":' || CASE WHEN p_partkey % 6 > 0 THEN '\"' || p_brand || '\"' ELSE 'null' END || ',\"size\":' || p_size || '}') AS hash FROM part",
    "merged_references": "WITH f AS (SELECT conv_id AS doc, role || (turn % 3) AS ref, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT doc, ref, CAST(row_number() OVER (PARTITION BY doc ORDER BY t) AS INTEGER) AS n FROM f",
    "reference_checks": "SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([o_orderkey % 5, o_orderkey % 7, o_orderkey % 3], lambda v: v > 2))), ',') AS unknown FROM orders",
    "carried_stress": """WITH p AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, max(CASE WHEN o_orderkey % 40 = 0 THEN o_totalprice END) AS value FROM orders GROUP BY 1, 2),
s AS (SELECT series, day, last_value(value IGNORE NULLS) OVER w AS v, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER w AS d FROM p WINDOW w AS (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT series, CAST(day AS VARCHAR) AS day, CASE WHEN date_diff('day', d, day) <= 10 THEN round(v, 2) END AS value, CASE WHEN date_diff('day', d, day) <= 10 THEN CAST(date_diff('day', d, day) AS INTEGER) END AS age FROM s""",
    "price_scan": "SELECT event_id, value FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' ORDER BY ts, event_id LIMIT 1000",
    "labelled_confirmation": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (event_id % 3 = 0) = (user_id % 2 = 0) END AS confirmed, CASE WHEN value >= 70 THEN 'critical' WHEN value >= 55 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS level FROM events",
}
