"""Queries on sessions, provider symbols and requests of bounded length."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import markets
from ..operators import prompts
from ..sources.tables import table

#: (asset, zone of its provider) of events by number.
_BARS = (
    ("US:SPY", "America/New_York"), ("INDEX:VIX", "America/Chicago"), ("CN:600519", "Asia/Shanghai"), ("FX:USD/CNY", "Europe/London"), ("FX:JPY", "Asia/Tokyo"), ("CRYPTO:BTC", "UTC"), ("US:SPY", "Europe/London"), ("INDEX:CSI300", "Asia/Shanghai"),
)
_ASSETS = ("US:BRK.B", "THEME:AI", "CN:600519", "CN:000001", "CN:830799", "CRYPTO:ETH", "FX:JPY", "INDEX:XX", "a:b:c", "theme:crypto", "US:SPY", "CN:12345")
_TOPICS = ("ai chips", "macro", "")


def _pick(words, by):
    return F.get(F.array(*map(F.lit, words)), by.cast("int"))


def session_closes(spark, d):
    """Order days, over several years and clock changes, as daily bars of several markets."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % len(_BARS)
    seconds = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400 + (F.col("o_orderkey") % 24) * 3600
    asset, zone = (_pick(values, k) for values in zip(*_BARS, strict=True))
    return o.select("o_orderkey", asset.alias("asset"), markets.observed(seconds, asset, F.when(F.col("o_orderkey") % 11 > 0, "1d").otherwise("1h"), zone).alias("o")).select("o_orderkey", "asset", "o.at", "o.basis")


def provider_assets(spark, d):
    p = table(spark, d, "part", "p_partkey")
    k = F.col("p_partkey")
    asset, provider = _pick(_ASSETS, k % len(_ASSETS)), F.when(k % 5 == 0, "tencent").otherwise("yahoo")
    return p.select("p_partkey", markets.resolved(asset, provider).alias("r"), markets.benchmark(asset, _pick(_TOPICS, k % 3)).alias("benchmark")).select("p_partkey", "r.requested", "r.price_asset", "r.symbol", "r.proxy_for", "benchmark")


def _prompt(parts) -> str:
    return "Sum up the evidence.\n" + json.dumps([{"id": p["at"], "text": p["text"]} for p in parts], ensure_ascii=False)


def bounded_requests(spark, d):
    """Whole documents in requests: how many parts and characters each has."""
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), F.lit(0).alias("at"), "text")
    return prompts.bounded(docs, _prompt).groupBy("doc", "request").agg(F.count("*").alias("parts"), F.sum(F.length("text")).alias("characters"), F.min("start").alias("start"))


QUERIES = {f.__name__: f for f in (session_closes, provider_assets, bounded_requests)}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _map(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_CLOSE = "CASE zone " + " ".join(f"WHEN '{z}' THEN INTERVAL '{h}:{m:02}:00'" for z, (h, m) in markets.CLOSES.items()) + " END"
SQL = {
    "session_closes": f"""
WITH x AS (
  SELECT o_orderkey, {_list(a for a, _ in _BARS)}[o_orderkey % {len(_BARS)} + 1] AS asset, {_list(z for _, z in _BARS)}[o_orderkey % {len(_BARS)} + 1] AS zone, o_orderkey % 11 > 0 AS daily,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 + (o_orderkey % 24) * 3600 AS BIGINT) AS s FROM orders),
y AS (SELECT *, CAST(timezone(zone, make_timestamptz(s * 1000000)) AS DATE) AS day, daily AND (asset LIKE 'FX:%') AS fx, daily AND asset NOT LIKE 'FX:%' AND asset <> 'CRYPTO:BTC' AND zone <> 'Europe/London' AS equity FROM x)
SELECT o_orderkey, asset, CAST(CASE WHEN fx THEN CASE WHEN isodow(day) < 6 THEN epoch(timezone('America/New_York', day + INTERVAL 17 HOUR)) END WHEN equity THEN epoch(timezone(zone, day + {_CLOSE})) ELSE s END AS BIGINT) AS at,
       CASE WHEN fx OR equity THEN 'market_close' ELSE 'provider' END AS basis FROM y""",
    "provider_assets": f"""
WITH x AS (SELECT p_partkey, {_list(_ASSETS)}[p_partkey % {len(_ASSETS)} + 1] AS raw, p_partkey % 5 = 0 AS tencent, {_list(_TOPICS)}[p_partkey % 3 + 1] AS topic FROM part),
k AS (SELECT *, CASE WHEN length(raw) - length(replace(raw, ':', '')) = 1 THEN upper(raw) END AS key FROM x),
p AS (SELECT *, coalesce({_map("key", markets.THEME_PRICES)}, key) AS price FROM k),
b AS (SELECT *, split_part(price, ':', 1) AS prefix, split_part(price, ':', 2) AS body FROM p),
e AS (SELECT *, CASE WHEN NOT regexp_full_match(body, '[0-9]{{6}}') THEN NULL WHEN regexp_matches(body, '^(4|8|92)') THEN 'BJ' WHEN regexp_matches(body, '^(5|6|9|110|113|118)') THEN 'SS' ELSE 'SZ' END AS place FROM b)
SELECT p_partkey, coalesce(key, raw) AS requested, price AS price_asset, CASE WHEN tencent THEN CASE WHEN prefix = 'CN' AND place IS NOT NULL THEN {_map("place", {"SS": "sh", "SZ": "sz", "BJ": "bj"})} || body END
  ELSE coalesce({_map("price", markets.SYMBOLS)}, CASE prefix WHEN 'US' THEN replace(body, '.', '-') WHEN 'CN' THEN body || '.' || place WHEN 'CRYPTO' THEN body || '-USD' END) END AS symbol,
  CASE WHEN price <> key THEN key END AS proxy_for,
  CASE WHEN key LIKE 'THEME:%' THEN 'US:SPY' WHEN key IS NULL THEN NULL WHEN topic = 'ai chips' THEN 'US:SOXX' WHEN prefix = 'US' THEN CASE WHEN key <> 'US:SPY' THEN 'US:SPY' END WHEN prefix = 'CN' THEN 'INDEX:CSI300' WHEN prefix = 'CRYPTO' THEN 'CRYPTO:BTC'
    ELSE {_map("key", markets.BENCHMARKS)} END AS benchmark FROM e""",
}
