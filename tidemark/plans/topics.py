"""Queries on what texts are about, on policy notices and on openings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy, signals, topics
from ..functions import topic_values as V
from ..operators import news
from ..sources.tables import table

_HEADLINES = (
    "Show HN: a Rust database for vector search", "CVE-2026-1234: remote code execution in the Linux kernel", "OpenAI ships a new LLM agent", "Regulator drafts a law on privacy", "Kubernetes outage: a postmortem", "How we manage engineers", "A paper on formal verification of C++ compilers",
    "GPU prices and the semiconductor supply", "大模型 推理 成本", "FOMC minutes: inflation and employment", "Tariff on steel, 关税", "人民币 汇率 走弱", "Housing and the bank", "a walk in the park", "PostgreSQL performance in production",
)
_SOURCES = (("Federal Reserve", "https://e.com/newsevents/speech/x"), ("Federal Reserve", "https://e.com/a"), ("中国人民银行", "http://www.pbc.gov.cn/a"), ("中国人民银行", "https://e.com/b"), ("wire", "https://e.com/c"))


def _rows(spark, d):
    title = F.get(F.array(*map(F.lit, _HEADLINES)), (F.col("doc_id") % len(_HEADLINES)).cast("int"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", title.alias("title"), F.col("text").alias("evidence"))


def categories(spark, d):
    return topics.assigned(_rows(spark, d)).select("doc_id", "category", F.array_join("tags", ",").alias("tags"))


def source_tiers(spark, d):
    e = table(spark, d, "events", "event_id", "event_type")
    tier = signals.source_tier(F.col("event_id") % 9 == 0, F.col("event_id") % 4 == 0, F.col("event_id") % 2 == 0)
    return e.select("event_id", tier.alias("tier"), signals.substring_hits(F.concat_ws(" ", F.lit("forward"), "event_type"), ("war", "view", "click")).alias("hits"))


def policy_notices(spark, d):
    rows = _rows(spark, d)
    k = F.floor(F.col("doc_id") / len(_HEADLINES)) % len(_SOURCES)
    source, url = (F.get(F.array(*map(F.lit, values)), k.cast("int")) for values in zip(*_SOURCES, strict=True))
    text, given = F.concat_ws(" ", "title", "evidence"), F.when(F.col("doc_id") % 11 == 0, " FOMC_Statement").when(F.col("doc_id") % 11 == 1, "other")
    found = policy.touched(text)
    return rows.select(
        "doc_id", policy.severity(text).alias("severity"), F.array_join(found["tickers"], ",").alias("tickers"), F.array_join(found["sectors"], ",").alias("sectors"), policy.category(given, F.col("title"), source, url).alias("category")
    )


def opportunities(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    found = policy.opportunities(F.col("l_quantity"), F.col("l_discount") * 10 - 0.5, F.col("l_linenumber") - 1, -F.col("l_tax") * 100 + 4, F.col("l_tax") * 10 + 7)
    name = F.transform(found, lambda o: F.concat_ws("/", o["kind"], o["asset"], o["confidence"], o["timeframe"]))
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), name.alias("opportunities"), F.when(F.col("l_tax") > 0.05, F.array(F.lit("tax"))).otherwise(F.array().cast("array<string>")).alias("risks"))
    return news.scenario_edges(rows)


QUERIES = {f.__name__: f for f in (categories, source_tiers, policy_notices, opportunities)}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sign(pattern: str, exact: bool) -> str:
    for a, b in (("(?<![a-z0-9])", "(?:^|[^a-z0-9])"), ("(?![a-z0-9])", "(?:$|[^a-z0-9])"), ("(?<![A-Za-z0-9])", "(?:^|[^A-Za-z0-9])"), ("(?![A-Za-z0-9])", "(?:$|[^A-Za-z0-9])"), ("'", "''")):
        pattern = pattern.replace(a, b)
    return ("" if exact else "(?i)") + pattern


def _scores(rules: dict, order) -> str:
    one = lambda p, a, b, exact: f"CASE WHEN regexp_matches(t, '{_sign(p, exact)}') THEN {a} ELSE 0 END + CASE WHEN regexp_matches(e, '{_sign(p, exact)}') THEN {b} ELSE 0 END"
    rows = ["{'k': " + str(i) + f", 'key': '{key}', 's': " + (" + ".join(one(*r) for r in rules.get(key, ())) or "0") + "}" for i, key in enumerate(order)]
    return f"list_sort(list_transform(list_filter([{', '.join(rows)}], lambda x: x.s > 0), lambda x: {{'l': -x.s, 'k': x.k, 'key': x.key}}))"


_X = f"x AS (SELECT doc_id, {_list(_HEADLINES)}[CAST(doc_id % {len(_HEADLINES)} AS INTEGER) + 1] AS title, coalesce(text, '') AS text FROM documents)"
_HAS = lambda words: "(" + " OR ".join(f"contains(b, '{w}')" for w in words) + ")"
_TOUCHED = lambda k: "list_filter(flatten([" + ", ".join(f"CASE WHEN {_HAS(rule[0])} THEN {_list(rule[k])} ELSE [] END" for rule in policy.TOUCHED) + "]), lambda v: v IS NOT NULL)"
_ONCE = "array_to_string(list_filter({0}, lambda v, i: list_position({0}, v) = i), ',')"
_OPEN = {
    "l_quantity > 35": f"panic_buying/{policy.STOCKS}/high/中长期 (6-12个月)", "l_quantity > 28 AND l_quantity <= 35": f"panic_buying/{policy.STOCKS}/medium/中长期 (3-6个月)",
    "l_discount * 10 - 0.5::DOUBLE > -0.2::DOUBLE AND l_discount * 10 - 0.5::DOUBLE < 0.3::DOUBLE": f"curve_normalization/{policy.BANKS}/medium/中期 (1-3个月)", "l_linenumber > 1 AND -l_tax * 100 + 4 < -2": f"dip_buying/{policy.GOLD}/medium/中长期 (3-12个月)",
    "l_tax * 10 + 7 > 7.20::DOUBLE": f"currency_tailwind/{policy.EXPORTS}/medium/短期 (1-3个月)",
}
SQL = {
    "categories": f"""
WITH {_X}, y AS (SELECT doc_id, title AS t, left(trim(regexp_replace(regexp_replace(text, '[À-ÖØ-öø-ÿ]', '_', 'g'), '\\s+', ' ', 'g')), {V.EVIDENCE}) AS e FROM x),
s AS (SELECT doc_id, {_scores(V.CATEGORY_RULES, V.CATEGORIES)} AS c, {_scores(V.TAG_RULES, V.SUBJECTS)} AS o, {_scores(V.TAG_RULES, V.LENSES)} AS l FROM y)
SELECT doc_id, coalesce(c[1].key, 'general_interest') AS category, CASE WHEN len(l) = 0 THEN array_to_string(list_transform(o[1:2], lambda v: v.key), ',') WHEN len(o) = 0 THEN array_to_string(list_transform(l[1:2], lambda v: v.key), ',') ELSE o[1].key || ',' || l[1].key END AS tags FROM s""",
    "source_tiers": """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'official' WHEN event_id % 4 = 0 THEN 'first_party' WHEN event_id % 2 = 0 THEN 'reporting' ELSE 'discovery' END AS tier,
  CAST(1 + CAST(event_type = 'view' AS INTEGER) + CAST(event_type = 'click' AS INTEGER) AS INTEGER) AS hits FROM events""",
    "policy_notices": f"""
WITH {_X}, y AS (SELECT doc_id, lower(title || ' ' || text) AS b, title, doc_id // {len(_HEADLINES)} % {len(_SOURCES)} AS k FROM x),
z AS (SELECT *, {_TOUCHED(1)} AS t, {_TOUCHED(2)} AS s, title LIKE '%FOMC%' AS fomc, title LIKE '%minutes%' AS m FROM y)
SELECT doc_id, CASE WHEN {_HAS(policy.HIGH)} THEN 'high' WHEN {_HAS(policy.MEDIUM)} THEN 'medium' ELSE 'low' END AS severity, {_ONCE.format("t")} AS tickers, {_ONCE.format("s")} AS sectors,
  CASE WHEN doc_id % 11 = 0 THEN 'fomc_statement' WHEN k = 2 THEN 'pboc_announcement' WHEN k = 3 THEN 'policy_update' WHEN k = 0 THEN 'fed_speech' WHEN fomc AND m THEN 'fomc_minutes' WHEN k = 1 THEN 'fed_press_release' ELSE 'policy_update' END AS category FROM z""",
    "opportunities": f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _OPEN.items())}], lambda v: v IS NOT NULL) AS o, l_tax FROM lineitem)
SELECT id || ':opportunities:' || (p - 1) AS source_id, 'opportunities' AS kind, o[p] AS name FROM (SELECT id, o, unnest(range(1, len(o) + 1)) AS p FROM r) UNION ALL SELECT id || ':risks:0', 'risks', 'tax' FROM r WHERE l_tax > 0.05::DOUBLE""",
}
