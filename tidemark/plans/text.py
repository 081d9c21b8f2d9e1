"""Queries on identities of urls and titles, rule tables over texts, and stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, titles, urls
from ..operators import stories
from ..sources.tables import table
from .common import shown

_HOSTS = ["example.net", "example.org"]
#: Claims that are added to the tables' texts, by the number of the row, so that the rule tables find something in them.
_A = (
    "fed raises rate, bullish", "no upside expected", "tariff drop risk", "crude oil beats, benefit", "gpu stock buy", "bitcoin slump crash", "war in 3-6个月", "bank credit 看好", "never a buy this year", "中长期 positive",
    "software", "不看好 美股",
)
_B = ("strong opportunity", "not a negative", "1 - 3 月", "sell", "next quarter", "within days", "6-12个月 bearish")


def _docs(spark, d):
    """Pages by the title of their HTML."""
    title = F.replace(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("&amp;"), F.lit("&"))
    return table(spark, d, "pages", "page_id", "url", "html").select(F.col("page_id").alias("item_id"), title.alias("title"), "url")


def _pick(words, n):
    return F.get(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % n).cast("int"))


def _sentences(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "n_chars")
    return docs.select(F.col("doc_id").alias("event_id"), (F.col("n_chars") % 100).alias("value"), F.concat_ws(" ", "text", _pick(_A, len(_A)), _pick(_B, len(_B))).alias("t"))


def canonical_url(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.url_hash(urls.canonical_url(F.col("url"))).alias("hash"))


def publisher_url(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", urls.publisher_url(F.col("url"), _HOSTS).alias("article_url"))


def title_keys(spark, d):
    return _docs(spark, d).select("item_id", titles.normal_title(F.col("title")).alias("plain"), titles.dedup_key(F.col("title"), F.col("url")).alias("dedup_key"), titles.prefix_key(F.col("title")).alias("prefix_key"))


def dedup_exact(spark, d):
    return stories.dedup_exact(_docs(spark, d))


def dedup_prefix(spark, d):
    return stories.fold_prefixes(_docs(spark, d))


def html_text(spark, d):
    return table(spark, d, "pages", "page_id", "html").select("page_id", titles.plain_text(F.col("html")).alias("text"))


def amounts(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey")
    text = F.concat(F.lit("cut by "), F.col("o_orderkey") % 90, F.lit(" bps, then "), F.col("o_custkey") % 7, F.lit(".5% or "), F.col("o_orderkey") % 90, F.lit("bp for $"), F.lit("ABC and $TOOLONGS $XY"))
    return orders.select("o_orderkey", F.array_join(titles.amounts(text), ",").alias("amounts"), F.array_join(titles.cash_tags(text), ",").alias("tags"))


def substantive_text(spark, d):
    return table(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", titles.substantive(F.concat(F.get(F.array(F.lit("RT @someone "), F.lit("via https://t.co/x "), F.lit("")), (F.col("turn") % 3).cast("int")), F.when(F.col("turn") % 4 > 0, F.col("text")).otherwise(""))).alias("substantive"))


def rule_labels(spark, d):
    t = F.col("t")
    s = _sentences(spark, d)
    return s.select("event_id", rules.topic(t).alias("topic"), rules.stance(t).alias("stance"), rules.horizon(t).alias("horizon"))


def edge_scores(spark, d):
    s = _sentences(spark, d).withColumns({"topic": rules.topic(F.col("t")), "stance": rules.stance(F.col("t"))})
    impact = F.when(F.col("value") > 60, "high").when(F.col("value") > 20, "medium").otherwise("low")
    way = F.when(F.col("stance") == "unknown", "neutral").otherwise("positive")
    event = F.col("event_id") % 10 != 0
    return s.select("event_id", rules.confidence(F.col("event_id") % 3 == 0, F.col("stance"), F.col("topic"), event).alias("confidence"), rules.strength(impact, way, event).alias("strength"))


def heat_score(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "value")
    found = rules.heat(F.col("event_id") % 30 + 1, F.col("value"), F.col("user_id"), (F.col("event_id") % 48).cast("double"), F.col("event_id") % 4 == 0)
    return e.select("event_id", found.alias("heat"))


def risk_scores(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    q, day = F.col("l_quantity"), F.col("l_orderkey") % 17
    rows = li.withColumns({
        "recession": rules.recession_score(q, F.col("l_discount") * 10 - 0.5, F.col("l_tax") * 100 - 1), "stress": rules.stress_score(q, 100 + F.col("l_linenumber") * 1.5, F.col("l_discount") * 20, F.col("l_tax") * 100 - 1),
        "geopolitics": rules.geopolitics_score(F.col("l_linenumber") - 2, day), "china": rules.china_score(6.7 + day * 0.05, F.col("l_linenumber") == 3),
    })
    total = rules.composite(F.col("recession"), F.col("stress"), F.col("geopolitics"), F.col("china"))
    return rows.select("l_orderkey", "l_linenumber", "recession", "stress", "geopolitics", "china", total.alias("score"), rules.risk_level(total).alias("level"))


def public_impact(spark, d):
    docs = table(spark, d, "documents", "doc_id", "n_chars")
    labels = table(spark, d, "labels", "doc_id", "quality", "toxic")
    rule = F.when(F.col("n_chars") > 4000, "high").when(F.col("n_chars") > 1000, "medium").otherwise("low")
    level = F.when(F.col("toxic") == 1, "none").when(F.col("quality") == 1, "high").otherwise("low")
    current = F.col("quality").isNotNull()
    impact = rules.public_impact(rule, level, F.when(F.col("quality") == 1, 0.8).otherwise(0.5), current)
    return docs.join(labels, "doc_id", "left").select("doc_id", impact.alias("impact"), F.when(current, "ai").otherwise("rule").alias("basis"))


def _sightings(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("event_id").alias("sighting_id"), F.col("user_id").alias("event_id"), F.col("event_type").alias("kol_key"), F.when(F.col("event_id") % 5 < 3, "verified").when(F.col("event_id") % 5 == 3, "future").otherwise("unknown").alias("time_status"),
        (F.col("event_id") % 7 == 0).alias("owned_direct"), F.when(F.col("event_id") % 5 < 4, F.col("ts")).alias("published_at"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), "value",
    )


def best_sighting(spark, d):
    return stories.best_per_group(_sightings(spark, d), ["event_id"], stories.sighting_order()).select("event_id", "sighting_id", "time_status", "owned_direct")


def best_sighting_by_person(spark, d):
    return stories.best_per_group(_sightings(spark, d), ["event_id", "kol_key"], stories.sighting_order()).select("event_id", "kol_key", "sighting_id")


def event_feed(spark, d):
    """Page two of the feed: verified sightings of two people with a value of 5 or more, best of each event, newest first."""
    rows = _sightings(spark, d).where(F.col("kol_key").isin("click", "view") & (F.col("value") >= 5))
    best = stories.best_per_group(rows, ["event_id"], stories.sighting_order()).where("time_status = 'verified'")
    return best.orderBy(F.desc("published_at"), F.desc("sighting_id")).offset(20).limit(20).select("event_id", "sighting_id", "kol_key", "value")


def source_counts(spark, d):
    s = table(spark, d, "documents", "doc_id", "source", "lang").select((F.col("doc_id") % 50).alias("event_id"), F.when(F.col("lang") == "de", "  ").otherwise(F.col("source")).alias("source_url"))
    return stories.source_counts(s)


def cluster_siblings(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "user_id").select("event_id", F.concat_ws("/", "user_id", F.to_date("ts")).alias("cluster_key"), "ts")
    return stories.siblings(e)


def alias_classes(spark, d):
    kinds = F.array(F.concat(F.lit("u:"), F.md5("url")), F.concat(F.lit("t:"), F.md5("title")))
    return stories.alias_classes(_docs(spark, d).select("item_id", F.explode(kinds).alias("alias")))


def merged_stories(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    rows = e.select((F.col("event_id") % 400).alias("class_id"), F.col("event_id").alias("item_id"), (F.col("user_id") % 3).alias("tier"), F.col("value").alias("impact"), "ts", F.col("event_type").alias("url"))
    return shown(stories.merged_stories(rows))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_url, publisher_url, title_keys, dedup_exact, dedup_prefix, html_text, amounts, substantive_text, rule_labels, edge_scores, heat_score, risk_scores, public_impact,
        best_sighting, best_sighting_by_person, event_feed, source_counts, cluster_siblings, alias_classes, merged_stories,
    )
}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _word(words) -> str:
    return f"regexp_matches(lower(t), '(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])')"


def _any(words, column: str = "t") -> str:
    return f"regexp_matches(lower({column}), '{rules.any_word(tuple(words))}')"


def _hits(words, column: str = "t") -> str:
    return " + ".join(f"CASE WHEN {_any([w], column)} AND NOT regexp_matches(lower({column}), '{rules.negation(w)}') THEN 1 ELSE 0 END" for w in words)


def _stepped(value: str, table_) -> str:
    return "CASE " + " ".join(f"WHEN {value} > {limit} THEN {points}" for limit, points in table_) + " ELSE 0 END"


_P = urls._PARTS
_D, _E = "url_decode(replace({}, '+', ' '))", "replace(url_encode({}), '%20', '+')"
_PATH = r"regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
_PAIRS = r"list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '{}'))"
_CANON = f"""part AS (SELECT page_id, regexp_extract(u, '{_P}', 1) AS scheme, regexp_extract(u, '{_P}', 2) AS host, regexp_replace(regexp_extract(u, '{_P}', 3), '/+$', '') AS path, list_transform(list_filter(list_filter(
  string_split(regexp_extract(u, '{_P}', 4), '&'), lambda x: regexp_matches(x, '=.')), lambda x: NOT list_contains({_list(urls.TRACKING)}, lower({_D.format("split_part(x, '=', 1)")}))),
  lambda x: {_E.format(_D.format("regexp_extract(x, '^([^=]*)=', 1)"))} || '=' || {_E.format(_D.format("regexp_extract(x, '^[^=]*=(.*)$', 1)"))}) AS q, u FROM (SELECT page_id, coalesce(trim(url), '') AS u FROM pages)),
c AS (SELECT page_id, CASE WHEN u = '' THEN '' ELSE CASE WHEN scheme <> '' THEN lower(scheme) || ':' ELSE '' END || CASE WHEN host <> '' THEN '//' || lower(host) ELSE '' END || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM part)"""
_COMPATIBLE = ", ".join("'" + x.replace("'", "''") + "'" for x in titles.compatible())
_PAGE_TITLE = "replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&')"
_TITLE = rf"""{_CANON}, raw AS (SELECT page_id AS item_id, {_PAGE_TITLE} AS title, regexp_replace(lower(translate({_PAGE_TITLE}, {_COMPATIBLE})), '[^\p{{L}}\p{{N}}]+|[{titles.LETTER_SEPARATORS}]', '', 'g') AS p0 FROM pages),
cut AS (SELECT *, length(p0) AS n, list_filter(range(greatest(length(p0) // 2, 1), greatest(length(p0) - 6, 1) + 1), lambda k: k >= length(p0) / 2 AND length(p0) - k >= 6 AND starts_with(p0, substr(p0, k + 1))) AS places FROM raw),
titled AS (SELECT item_id, canonical AS url, title, CASE WHEN n >= 12 AND len(places) > 0 THEN substr(p0, 1, places[1]) ELSE p0 END AS plain FROM cut JOIN c ON item_id = page_id)"""
_KEY = "left(sha1(CASE WHEN plain <> '' THEN plain ELSE url END), 20)"
_SENT = f"s AS (SELECT doc_id AS event_id, n_chars % 100 AS value, concat_ws(' ', text, {_list(_A)}[doc_id % {len(_A)} + 1], {_list(_B)}[doc_id % {len(_B)} + 1]) AS t FROM documents)"
_TOPIC = "CASE " + " ".join(f"WHEN {_any(w)} THEN '{name}'" for name, w in rules.TOPICS) + " ELSE 'general' END"
_LABEL = f"""l AS (SELECT *, {_TOPIC} AS topic, CASE WHEN good > bad THEN 'bullish' WHEN bad > good THEN 'bearish' ELSE 'unknown' END AS stance FROM (SELECT *, {_hits(rules.POSITIVE)} AS good, {_hits(rules.NEGATIVE)} AS bad FROM s))"""
_SIGHT = """g AS (SELECT event_id AS sighting_id, user_id AS event_id, event_type AS kol_key, CASE WHEN event_id % 5 < 3 THEN 'verified' WHEN event_id % 5 = 3 THEN 'future' ELSE 'unknown' END AS time_status,
  event_id % 7 = 0 AS owned_direct, CASE WHEN event_id % 5 < 4 THEN ts END AS published_at, ts, value FROM events)"""
_ORDER = "(time_status = 'verified') DESC, owned_direct DESC, CASE WHEN time_status = 'verified' THEN published_at END DESC NULLS LAST, ts DESC, sighting_id DESC"
_SCRIPT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
SQL = {
    "canonical_url": f"WITH {_CANON} SELECT page_id, canonical, left(sha1(canonical), 16) AS hash FROM c",
    "publisher_url": f"""SELECT page_id, CASE WHEN regexp_matches(u, '^(?i)https://') AND (h IN ('example.net', 'example.org') OR ends_with(h, '.example.net') OR ends_with(h, '.example.org'))
  THEN 'https://' || h || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN len({_PAIRS.format("^utm_")}) > 0 THEN '?' || array_to_string(list_sort({_PAIRS.format("^utm_")}), '&') ELSE '' END END AS article_url
  FROM (SELECT page_id, trim(url) AS u, regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS h FROM pages)""",
    "title_keys": f"WITH {_TITLE} SELECT item_id, plain, {_KEY} AS dedup_key, CASE WHEN length(plain) >= 12 THEN left(sha1(left(plain, 12)), 16) END AS prefix_key FROM titled",
    "dedup_exact": f"WITH {_TITLE} SELECT {_KEY} AS dedup_key, min(item_id) AS keep_id, count(*) AS members, arg_max(title, (length(title), -item_id)) AS title FROM titled GROUP BY 1",
    "dedup_prefix": f"""WITH {_TITLE}, p AS (SELECT DISTINCT plain, left(plain, 12) AS b FROM titled WHERE length(plain) >= 16),
r AS (SELECT s.plain, arg_max(a.plain, (length(a.plain), a.plain)) AS root FROM p a JOIN p s ON a.b = s.b AND starts_with(a.plain, s.plain) GROUP BY s.plain)
SELECT item_id, coalesce(root, plain) AS class_title FROM titled LEFT JOIN r USING (plain)""",
    "html_text": f"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '{_SCRIPT}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages""".replace("\\\\", "\\"),
    "amounts": """SELECT o_orderkey, array_to_string(list_sort(list_distinct([(o_orderkey % 90) || 'bp', (o_custkey % 7) || '.5pct'])), ',') AS amounts, 'ABC,XY' AS tags FROM orders""",
    "substantive_text": r"""WITH x AS (SELECT conv_id, turn, ['RT @someone ', 'via https://t.co/x ', ''][turn % 3 + 1] || CASE WHEN turn % 4 > 0 THEN text ELSE '' END AS t FROM conversations)
SELECT conv_id, turn, length(regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '^(RT @someone|via) ', ''), 'https?://\S+', ' ', 'g'), '[^\p{L}\p{N}]+', '', 'g')) >= 3 AS substantive FROM x""",
    "rule_labels": rf"""WITH {_SENT}, {_LABEL}, h AS (SELECT *, lower(trim(t)) AS low, regexp_extract(lower(t), '[0-9]+\s*[-–—至到]\s*([0-9]+)\s*个?月', 1) AS m FROM l)
SELECT event_id, topic, stance, CASE WHEN low = '' OR regexp_matches(low, '{"|".join(rules.UNCERTAIN)}') THEN 'unknown' WHEN m <> '' THEN CASE WHEN CAST(m AS INTEGER) <= 3 THEN 'short' WHEN CAST(m AS INTEGER) <= 6 THEN 'medium' ELSE 'long' END
  {" ".join(f"WHEN regexp_matches(low, '{'|'.join(w)}') THEN '{name}'" for name, w in rules.HORIZONS)} ELSE 'unknown' END AS horizon FROM h""",
    "edge_scores": f"""WITH {_SENT}, {_LABEL}, x AS (SELECT *, least(0.30::DOUBLE + CASE WHEN event_id % 3 = 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN stance <> 'unknown' THEN 0.20::DOUBLE ELSE 0 END
  + CASE WHEN topic <> 'general' THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN event_id % 10 <> 0 THEN 0.05::DOUBLE ELSE 0 END, 0.95) AS c FROM l)
SELECT event_id, round(CASE WHEN stance = 'unknown' THEN least(c, 0.45) ELSE c END, 2) AS confidence, round(least(CASE WHEN event_id % 10 <> 0 THEN 0.30::DOUBLE ELSE 0.45 END
  + CASE WHEN value > 60 THEN 0.30::DOUBLE WHEN value > 20 THEN 0.15 ELSE 0.05 END + CASE WHEN stance <> 'unknown' THEN 0.15::DOUBLE ELSE 0 END, 1.0), 2) AS strength FROM x""",
    "heat_score": """SELECT event_id, round(greatest(0.0, least(100.0, e * (0.35::DOUBLE + 0.65::DOUBLE * f) + 20 * f)), 1) AS heat FROM (SELECT event_id, pow(2.0::DOUBLE, -CAST(event_id % 48 AS DOUBLE) / 8) AS f,
  35 / (1 + 0.08::DOUBLE * (event_id % 30)) + 20 * least(1.0, ln(1 + value) / ln(501::DOUBLE)) + 15 * least(1.0, ln(1 + user_id) / ln(251::DOUBLE)) + CASE WHEN event_id % 4 = 0 THEN 10 ELSE 0 END AS e FROM events)""",
    "risk_scores": f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS vix, l_discount * 10 - 0.5::DOUBLE AS curve, l_tax * 100 - 1 AS stress, 100 + l_linenumber * 1.5::DOUBLE AS dollar, l_discount * 20 AS moved,
  l_linenumber - 2 AS hi, l_orderkey % 17 AS med, 6.7::DOUBLE + (l_orderkey % 17) * 0.05::DOUBLE AS cny FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber,
  CAST(least(100, 30 + {_stepped("vix", ((35, 30), (28, 20), (20, 10)))} + CASE WHEN curve < -0.4::DOUBLE THEN 25 WHEN curve < 0 THEN 15 WHEN curve < 0.3::DOUBLE THEN 5 ELSE 0 END + {_stepped("stress", ((5, 25), (2, 15), (0, 5)))}) AS INTEGER) AS recession,
  CAST(least(100, 20 + {_stepped("vix", ((35, 25), (28, 15), (20, 5)))} + {_stepped("dollar", ((108, 20), (105, 10)))} + CASE WHEN abs(moved) > 1 THEN 10 ELSE 0 END + {_stepped("stress", ((5, 15), (2, 10), (0, 5)))}) AS INTEGER) AS stress,
  CAST(least(100, 20 + CASE WHEN hi >= 3 THEN 35 WHEN hi >= 1 THEN 20 ELSE 0 END + CASE WHEN med >= 5 THEN 15 WHEN med >= 2 THEN 5 ELSE 0 END) AS INTEGER) AS geopolitics,
  CAST(greatest(0, least(100, 25 + {_stepped("cny", (("7.30::DOUBLE", 30), ("7.20::DOUBLE", 20), ("7.10::DOUBLE", 10)))} - CASE WHEN cny < 6.80::DOUBLE THEN 5 ELSE 0 END + CASE WHEN l_linenumber = 3 THEN 10 ELSE 0 END)) AS INTEGER) AS china FROM x),
c AS (SELECT *, CAST(round_even(0.30::DOUBLE * recession + 0.25::DOUBLE * stress + 0.20::DOUBLE * geopolitics + 0.25::DOUBLE * china, 0) AS INTEGER) AS score FROM s)
SELECT *, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 55 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level FROM c""",
    "public_impact": """WITH x AS (SELECT doc_id, quality, CASE WHEN n_chars > 4000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' ELSE 'low' END AS rule, CASE WHEN toxic = 1 THEN 'none' WHEN quality = 1 THEN 'high' ELSE 'low' END AS level,
  quality IS NOT NULL AND coalesce(quality, 0) = 1 AS heard FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE rule WHEN 'high' THEN 'high' WHEN 'medium' THEN CASE WHEN heard AND level = 'high' THEN 'high' WHEN heard AND level = 'none' THEN 'low' ELSE 'medium' END
  ELSE CASE WHEN heard AND level IN ('high', 'medium') THEN 'medium' ELSE 'low' END END AS impact, CASE WHEN quality IS NULL THEN 'rule' ELSE 'ai' END AS basis FROM x""",
    "best_sighting": f"WITH {_SIGHT} SELECT event_id, sighting_id, time_status, owned_direct FROM g QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY {_ORDER}) = 1",
    "best_sighting_by_person": f"WITH {_SIGHT} SELECT event_id, kol_key, sighting_id FROM g QUALIFY row_number() OVER (PARTITION BY event_id, kol_key ORDER BY {_ORDER}) = 1",
    "event_feed": f"""WITH {_SIGHT}, b AS (SELECT * FROM g WHERE kol_key IN ('click', 'view') AND value >= 5 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY {_ORDER}) = 1)
SELECT event_id, sighting_id, kol_key, value FROM b WHERE time_status = 'verified' ORDER BY published_at DESC, sighting_id DESC LIMIT 20 OFFSET 20""",
    "source_counts": "SELECT doc_id % 50 AS event_id, greatest(1, count(DISTINCT CASE WHEN lang <> 'de' THEN source END)) AS sources FROM documents GROUP BY 1",
    "cluster_siblings": """WITH e AS (SELECT event_id, ts, user_id || '/' || CAST(ts AS DATE) AS k FROM events),
p AS (SELECT a.event_id, b.event_id AS sibling_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS k FROM e a JOIN e b ON a.k = b.k AND a.event_id <> b.event_id)
SELECT event_id, sibling_id, CAST(k AS INTEGER) AS k FROM p WHERE k <= 12""",
    "alias_classes": f"""WITH RECURSIVE a AS (SELECT page_id, md5(url) AS x, md5({_PAGE_TITLE}) AS y FROM pages),
e AS (SELECT a.page_id AS u, b.page_id AS v FROM a JOIN a b ON a.x = b.x UNION SELECT a.page_id, b.page_id FROM a JOIN a b ON a.y = b.y),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS item_id, min(v) AS class_id FROM r GROUP BY u""",
    "merged_stories": """SELECT event_id % 400 AS class_id, arg_min(event_id, (-(user_id % 3), -epoch_us(ts), event_id)) AS base_id, round(max(value), 6) AS impact, max(ts) AS updated, count(*) AS members, CAST(count(DISTINCT event_type) AS INTEGER) AS urls FROM events GROUP BY 1""",
}
