"""Queries on the relevance of sightings and on the story store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import relevance_values as V
from ..functions import titles
from ..operators import relevance, story_store
from ..sources.scratch import shared_dir
from ..sources.tables import table
from .text import _TITLE

#: Headlines set before the tables' texts, by the number of the row, so that the rules find people, companies and events.
_HEADLINES = (
    "Trump says stocks could rise after tariff talks", "Stocks Trump Bonds After Rate-Cut Expectations", "Elon Musk unhurt after car crash on highway", "Powell holds rates steady", "Powell Industries stock rises after earnings",
    "Zuckerberg warns the AI bubble may collapse", "Meta shares crash after guidance cut", "New meta-analysis reviews sleep patterns", "Michael Burry shorts Tesla", "Warren Buffett buys Apple pie", "Tesla cuts prices",
    "Fed raises rates by 25 basis points", "Trump announces 25% tariffs on steel", "WAR", "a price war", "missile war in Iran", "特斯拉 召回 车辆", "马斯克 宣布 裁员", "Stock up on the pantry", "buy $NVDA now", "RT @a",
)
#: (person, name, Chinese name, label of the source, url, configured account).
_PEOPLE = (
    ("trump", "Donald Trump", "特朗普", "Truth Social @realDonaldTrump", "https://truthsocial.com/@realDonaldTrump/123", None), ("musk", "Elon Musk", "马斯克", "X @elonmusk", "https://x.com/elonmusk/status/1", None),
    ("powell", "Jerome Powell", "鲍威尔", "Bing News", "https://example.com/a", None), ("zuckerberg", "Mark Zuckerberg", "扎克伯格", "X @finkd", "https://x.com/FinkD/status/3", "@finkd"),
    ("burry", "Michael Burry", "迈克尔·伯里", "X @burry", "https://x.com/other/status/3", "burry"), ("buffett", "Warren Buffett", "巴菲特", "rss", "https://example.com/b", None), (" Musk ", "the of", "un", "rss", "https://truthsocial.com/x", None),
)


def _pick(words, by):
    return F.get(F.array(*[F.lit(w) for w in words]), by.cast("int"))


def event_relevance(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    who = F.col("doc_id") % len(_PEOPLE)
    title = _pick(_HEADLINES, F.floor(F.col("doc_id") / len(_PEOPLE)) % len(_HEADLINES))
    columns = [_pick(values, who).alias(c) for c, values in zip(("kol_key", "kol_name", "kol_name_cn", "source", "url", "handle"), zip(*_PEOPLE, strict=True), strict=True)]
    rows = docs.select("doc_id", title.alias("title"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("snippet"), *columns)
    return relevance.assess(rows).select("doc_id", "relevance.*")


def stored_stories(spark, d):
    """Pages as observations, joined to a store in three batches; a third of the titles cut short."""
    pages = table(spark, d, "pages", "page_id", "url", "html")
    title = F.replace(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("&amp;"), F.lit("&"))
    cut = F.when(F.col("page_id") % 3 == 0, F.left(title, F.lit(24))).otherwise(title)
    level = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("page_id") % 3 + 1).cast("int"))
    seen = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("page_id") * 60)
    rows = pages.select(
        F.col("page_id").alias("item_id"), cut.alias("title"), F.lit(None).cast("string").alias("snippet"), F.lit("page").alias("source"), "url", F.concat(F.lit("p"), F.col("page_id") % 4).alias("kol_key"), level.alias("impact"),
        (F.col("page_id") % 7 == 0).alias("has_market_kw"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("T"), F.col("page_id"))).alias("tickers"), F.lit(None).cast("timestamp").alias("published_at"), seen.alias("seen_at"),
    )
    folder = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/stories-{uuid.uuid4().hex}"
    for k in range(3):
        story_store.upsert(rows.where(F.floor(F.col("item_id") / 50) % 3 == k), folder, k, by_shown=False)
    found = story_store.stories(spark, folder)
    return found.select("event_id", "title", "impact", "has_market_kw", "tickers", "url", "kol_key", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"), "observations")


QUERIES = {"event_relevance": event_relevance, "stored_stories": stored_stories}


def _list(words):
    return "[" + ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in words) + "]"


def _says(pattern, text="t"):
    return f"regexp_matches({text}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


def _fenced(text):
    return f"regexp_replace(regexp_replace(lower({text}), '\\s+', ' ', 'g'), '([a-z0-9_]+)', chr(1) || '\\1' || chr(1), 'g')"


def _names():
    rows = [(key, kind, name) for kind, names in ((0, V.PERSONS), (1, V.COMPANIES)) for key, own in names.items() for name in own]
    return ", ".join("('{}', {}, '{}', {})".format(key, kind, name.replace("'", "''"), k) for k, (key, kind, name) in enumerate(rows))


_RULES = {
    "accident": f"{_says(V.PHYSICAL_CRASH)} AND NOT {_says(V.ACCIDENT_CONSEQUENCE)}", "held": f"NOT {_says(V.NON_BUSINESS)} AND {_says(V.RATE_HOLD)}",
    "shock": f"NOT {_says(V.PHYSICAL_CRASH)} AND {_says(V.MARKET_SHOCK)}", "figures": f"{_says(V.BUSINESS_METRIC)} OR {_says(V.CAPITAL_ALLOCATION)} OR {_says(V.CORPORATE_EVENT)}",
    "corporate": _says(V.CORPORATE_ACTION), "trade": _says(V.TRADE_ACTION), "thing": _says(V.BUSINESS_OBJECT), "position": _says(V.POSITION_OBJECT), "private": _says(V.NON_BUSINESS),
    "war": f"{_says(V.WAR)} AND NOT {_says(V.NON_GEO_WAR)}", "context": _says(V.GEO_CONTEXT), "warned": _says(V.MEDIUM),
    "severe": " OR ".join(_says(p) for p in (V.BUBBLE_CRISIS, V.RATE_DECISION, V.RATE_HOLD, V.TARIFF_ACTION, V.SYSTEMIC)),
    "asset": " OR ".join([r"regexp_matches(s, '(?:^|[^\w$])\$[A-Z]{1,5}\b')", *(_says(p, "s") for p in (V.FINANCE, V.FINANCE_CONTEXT, V.MARKET_SHOCK, V.BUBBLE_CRISIS))]),
}
_FLAT = r"trim(regexp_replace(title, '\s+', ' ', 'g'))"
_BARE = rf"regexp_replace({_FLAT}, '{story_store.ELLIPSIS.replace(chr(92) + 'u2026', '…')}', '')"
_BACK = f"list_filter(range((length({_BARE}) + 1) // 2, length({_BARE}) - 5), lambda k: starts_with({_BARE}, substr({_BARE}, k + 1)))"
_SHOWN = f"CASE WHEN len({_BACK}) > 0 THEN trim(substr({_BARE}, 1, {_BACK}[1])) ELSE {_FLAT} END"
_META = r"(?i)(?:^|[^A-Za-z0-9_])meta(?:[^A-Za-z0-9_]|$)"
SQL = {
    "event_relevance": rf"""
WITH rows AS (
  SELECT doc_id, {_list(_HEADLINES)}[CAST(doc_id // {len(_PEOPLE)} % {len(_HEADLINES)} AS INTEGER) + 1] AS title, CASE WHEN doc_id % 3 = 0 THEN text END AS snippet,
         {", ".join(f"{_list(values)}[CAST(doc_id % {len(_PEOPLE)} AS INTEGER) + 1] AS {c}" for c, values in zip(("kol_key", "name", "name_cn", "source", "url", "handle"), zip(*_PEOPLE, strict=True), strict=True))}
  FROM documents),
texts AS (
  SELECT *, trim(coalesce(title, '') || ' ' || coalesce(snippet, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS o, lower(trim(kol_key)) AS key FROM rows),
marked AS (
  SELECT *, regexp_replace(o, '[À-ÖØ-öø-ÿ]', '_', 'g') AS t, {_fenced("o")} AS fenced FROM texts),
sensed AS (SELECT *, regexp_replace(t, '(?i){V.AMBIGUOUS_FINANCE}', ' ', 'g') AS s FROM marked),
ruled AS MATERIALIZED (SELECT *, {", ".join(f"{rule} AS {name}" for name, rule in _RULES.items())} FROM sensed),
fixed(of, kind, name, k) AS (VALUES {_names()}),
names AS (
  SELECT doc_id, kind, f.name, k FROM ruled JOIN fixed f ON key = f.of
  UNION ALL SELECT doc_id, 0, u.name, 1000 + u.k FROM (SELECT doc_id, key, unnest([{{'name': name, 'k': 1}}, {{'name': name_cn, 'k': 2}}]) AS u FROM ruled) r
  WHERE length(u.name) >= 2 AND NOT EXISTS (SELECT 1 FROM fixed f WHERE f.of = r.key AND f.kind = 0 AND lower(f.name) = lower(u.name))),
parts AS (SELECT doc_id, o, string_split_regex(o, '(?i)\btrump\b') AS p FROM ruled WHERE key = 'trump'),
ends AS (SELECT doc_id, o, unnest(list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x))) + 5 * (k - 1))) AS spot FROM parts),
trumps AS (
  SELECT DISTINCT doc_id FROM ends WHERE substr(o, spot::BIGINT + 1, 5) IN ('Trump', 'TRUMP')
  AND NOT regexp_matches(substr(o, greatest(spot::BIGINT - 32, 0) + 1, spot::BIGINT + 37 - greatest(spot::BIGINT - 32, 0)), '(?i){V.TRUMP_VERB}')),
found AS (
  SELECT n.doc_id, n.kind, n.name, n.k FROM names n JOIN ruled r ON n.doc_id = r.doc_id
  WHERE contains(CASE WHEN regexp_matches(n.name, '^[A-Za-z0-9@$.''’&\- ]+$') THEN r.fenced ELSE lower(r.o) END, CASE WHEN regexp_matches(n.name, '^[A-Za-z0-9@$.''’&\- ]+$') THEN {_fenced("n.name")} ELSE lower(n.name) END)
  AND (n.kind = 0 OR lower(n.name) <> 'meta' OR regexp_matches(regexp_replace(r.o, '(?i)meta[-\s]?(?:analysis|analytic|review|study|data|model|learning)\b', ' ', 'g'), '{_META}'))
  AND (n.kind = 1 OR r.key <> 'trump' OR lower(n.name) <> 'trump' OR n.doc_id IN (SELECT doc_id FROM trumps))
  AND (n.kind = 1 OR r.key <> 'powell' OR lower(n.name) <> 'powell' OR regexp_matches(regexp_replace(r.o, '(?i)\bpowell{V.POWELL_COMPANY}', ' ', 'g'), '(?i)\bpowell\b'))),
first AS (SELECT doc_id, kind, name FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind, length(name) DESC, k) = 1),
posts AS (
  SELECT doc_id, CASE WHEN regexp_matches(trim(source), '(?i){V.DIRECT_SOURCE}')
    AND CASE WHEN lower(trim(source)) LIKE 'truth social @%' THEN regexp_matches(url, '^https://(www\.)?truthsocial\.com/') AND contains(url, '/@') ELSE regexp_matches(url, '^https://(www\.)?(x|twitter)\.com/') AND contains(lower(url), '/status/') END
    AND (said = lower(ltrim(trim(coalesce(handle, '')), '@')) OR (key, said) IN ({", ".join(f"('{k}', '{h}')" for k, own in V.HANDLES.items() for h in own)}))
    AND said <> '' AND said = lower(regexp_extract(regexp_extract(url, '^https://[^/]*(.*)$', 1), '/@?([A-Za-z0-9_]{{1,64}})/', 1)) THEN said END AS own
  FROM (SELECT *, lower(regexp_extract(source, '@([A-Za-z0-9_]{{1,64}})', 1)) AS said FROM ruled)),
bared AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(snippet, ''), title), '(?i)^\s*(?:RT|RETRUTH)\b[\s:：|\-—]*', ''), '(?i)^\s*(?:FROM|VIA|BY)\b[\s:：|\-—]*', ''),
    '(?i)(?:(?:https?:)?//|www\.)[^\s<>()]+', ' ', 'g'), '@[A-Za-z0-9_]{{1,64}}\b', ' ', 'g') AS bare FROM ruled),
told AS (SELECT doc_id, length(regexp_replace(bare, '[^\pL\pN]+', '', 'g')) >= 3 OR regexp_matches(bare, '\$[A-Za-z][A-Za-z0-9._-]{{0,9}}\b') AS own_words FROM bared),
judged AS (
  SELECT r.*, p.own, f.name AS alias_name, own_words,
         CASE WHEN p.own IS NOT NULL THEN 'direct_source' WHEN f.kind = 0 THEN 'person_mention' WHEN f.kind = 1 THEN 'company_mention' ELSE 'missing' END AS basis
  FROM ruled r JOIN posts p USING (doc_id) JOIN told USING (doc_id) LEFT JOIN first f USING (doc_id)),
worked AS (
  SELECT *, NOT private AND (figures OR CASE basis WHEN 'company_mention' THEN corporate OR (trade AND thing) WHEN 'direct_source' THEN (corporate OR trade) AND thing
    WHEN 'person_mention' THEN (corporate AND thing) OR (trade AND (position OR (key IN ({", ".join(f"'{k}'" for k in V.TRADERS)}) AND thing))) ELSE false END) AS business,
    war AND (context OR (key = 'trump' AND own IS NOT NULL)) AS fought FROM judged),
weighed AS (
  SELECT *, o <> '' AND NOT accident AND (asset OR held OR business OR fought) AS finance,
         o <> '' AND (own_words OR NOT (contains(lower(source), 'truth social') OR contains(lower(url), 'truthsocial.com/') OR own IS NOT NULL)) AS content, coalesce('@' || own, alias_name) AS alias FROM worked)
SELECT doc_id, content AND alias IS NOT NULL AS eligible, content AND alias IS NOT NULL AND finance AS intelligence_eligible, alias IS NOT NULL AS entity_match, finance AS finance_relevant,
       CASE WHEN NOT content THEN 'insubstantial_content' WHEN alias IS NULL THEN 'entity_not_found' WHEN NOT finance THEN 'non_finance' WHEN basis = 'direct_source' THEN 'direct_source_finance'
            WHEN basis = 'company_mention' THEN 'affiliated_company_finance' ELSE 'person_mention_finance' END AS reason,
       CASE WHEN NOT finance THEN 'low' WHEN shock OR severe OR fought THEN 'high' WHEN warned OR business THEN 'medium' ELSE 'low' END AS rule_impact,
       alias AS matched_alias, basis AS attribution_basis, '{relevance.VERSION}' AS classifier_version FROM weighed""",
    "stored_stories": f"""
WITH RECURSIVE {_TITLE.replace("pages)", "(SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '<title>' || left(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&'), 24) || '</title>' ELSE html END AS html FROM pages))")},
shown AS (
  SELECT t.item_id, plain, CASE WHEN plain <> '' THEN plain ELSE t.url END AS x, t.url AS y, {_SHOWN} AS title, trim(p.url) AS raw FROM titled t JOIN pages p ON t.item_id = p.page_id
  WHERE trim(title) <> '' AND trim(p.url) <> ''),
e AS (
  SELECT a.item_id AS u, b.item_id AS v FROM shown a JOIN shown b ON a.x = b.x UNION SELECT a.item_id, b.item_id FROM shown a JOIN shown b ON a.y = b.y
  UNION SELECT a.item_id, b.item_id FROM shown a JOIN shown b ON least(length(a.plain), length(b.plain)) >= {titles.LEAST} AND (starts_with(a.plain, b.plain) OR starts_with(b.plain, a.plain))),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
classes AS (SELECT u AS item_id, min(v) AS event_id FROM r GROUP BY u)
SELECT event_id, arg_max(title, (length(title), -item_id)) AS title, ['low', 'medium', 'high'][CAST(max(item_id % 3) AS INTEGER) + 1] AS impact, bool_or(item_id % 7 = 0) AS has_market_kw,
       CASE WHEN min(CASE WHEN item_id % 5 = 0 THEN item_id END) IS NOT NULL THEN 'T' || min(CASE WHEN item_id % 5 = 0 THEN item_id END) END AS tickers, arg_min(raw, item_id) AS url, 'p' || (min(item_id) % 4) AS kol_key,
       CAST(1767225600 + min(item_id) * 60 AS BIGINT) AS first_seen, CAST(1767225600 + max(item_id) * 60 AS BIGINT) AS last_seen, count(*) AS observations
FROM classes JOIN shown USING (item_id) GROUP BY event_id""",
}
