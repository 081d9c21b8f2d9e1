"""Queries on the claims of headlines and on clusters of briefing items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claim_values as V
from ..functions import claims, titles
from ..operators import clusters
from ..sources.tables import table

#: Headlines of every second document, by its number; the others have their own text.
_HEADLINES = (
    "Fed cuts rates by 25 basis points", "美联储降息25个基点", "Fed hikes rates by 50 bps", "Fed is not cutting rates by 25 basis points", "Fed to cut rates by 25 basis points", "OpenAI releases GPT-6 model", "OpenAI发布推理模型",
    "OpenAI may release GPT-6", "PBOC lowered the policy rate by 10.50 bps", "中国人民银行 宣布 下调政策利率 10 个基点", "万斯称伊朗冲突不是战争", "JD Vance says the Iran conflict is not a war", "Buffett trims its stake", "Tesla recalls vehicles",
    "Markets calm - Reuters", "快讯：市场平静 路透", "美联储降息25个基点？", "OpenAI launches a new reasoning model for developers", "Fed cuts rates by 25 basis points, not ending QT", "美联储加息，此前曾降息25个基点",
)


def _items(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    n = F.floor(F.col("doc_id") / 2)
    title = F.when(F.col("doc_id") % 2 == 0, F.get(F.array(*map(F.lit, _HEADLINES)), (n % len(_HEADLINES)).cast("int"))).otherwise(F.col("text"))
    published = F.when(F.col("doc_id") % 7 > 0, F.timestamp_seconds(F.lit(1_782_900_000) + (F.col("doc_id") % 5) * 21_600))
    return docs.select("doc_id", title.alias("title"), published.alias("published_at"))


def semantic_signatures(spark, d):
    rows = _items(spark, d).withColumn("text", claims.plain(F.col("title")))
    t = F.col("text")
    sig = claims.signature(t, F.col("published_at"), F.array().cast("array<string>"), F.lit("powell"))
    return rows.select("doc_id", claims.briefing_title(t).alias("named"), claims.action(t).alias("action"), F.array_join(sig, "|").alias("signature"))


def signature_clusters(spark, d):
    return semantic_signatures(spark, d).where("signature IS NOT NULL").groupBy("signature").agg(F.min("doc_id").alias("base_id"), F.count("*").alias("members"))


def briefing_clusters(spark, d):
    i = F.col("doc_id")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    rows = _items(spark, d).select(
        i.alias("item_id"), "title", "published_at", F.when(i % 3 == 0, F.concat(F.lit("doc:"), F.floor(i / 120))).alias("external_id"), F.when(i % 4 > 0, F.concat(F.lit("https://e.com/"), i % 400)).alias("canonical_url"),
        F.when(i % 5 == 0, F.concat(F.lit("c-"), i % 25)).alias("cluster_key"), F.lit("powell").alias("person"), F.array().cast("array<string>").alias("assets"), pick(clusters.TIERS, i).alias("tier"),
        pick(clusters.EVIDENCE, i).alias("evidence"), pick(clusters.IMPACTS, F.floor(i / 3)).alias("impact"), F.timestamp_seconds(F.lit(1_783_000_000) + i * 60).alias("observed_at"),
    )
    found = clusters.cluster(rows)
    return found.select("base_id", "impact", "members", "source_count", F.unix_seconds("observed_at").alias("observed_at"), "claim", "story_key")


QUERIES = {f.__name__: f for f in (semantic_signatures, signature_clusters, briefing_clusters)}


def _re2(pattern: str) -> str:
    """A pattern with bounds that take a letter, where looking around isn't known; enough to tell whether it is found."""
    for a, b in (("(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])"), ("(?![A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])"), ("(?=.{0,8}", "(?:.{0,8}"), (r"(?<!\d)", ""), ("'", "''")):
        pattern = pattern.replace(a, b)
    return "(?i)" + pattern


def _says(pattern: str, text: str = "t") -> str:
    return f"regexp_matches({text}, '{_re2(pattern)}')"


def _first(rows) -> str:
    return "CASE " + " ".join(f"WHEN {_says(p)} THEN '{name}'" for name, p in rows) + " END"


_NAMED = "t"
for _pattern, _to in V.SYNONYMS:
    _NAMED = f"regexp_replace({_NAMED}, '{_re2(_pattern)}', '{_to}', 'g')"
_NAMED = f"regexp_replace(regexp_replace({_NAMED}, '{V.PUBLISHER}', ''), '[^0-9a-z㐀-鿿]+', '', 'g')"
_SURE = " OR ".join(f"(action = '{name}' AND {_says('|'.join(f'(?:{w})' for w in wordings))})" for name, wordings in V.FACTS.items())
_SEVERAL = " + ".join(f"CAST({_says(p)} AS INTEGER)" for _, p in V.ACTIONS)
_NUMBER = "regexp_replace(CAST(CAST(x AS DOUBLE) AS VARCHAR), '\\.0$', '')"
_SIGNED = rf"""
x AS (
  SELECT doc_id, lower(left(trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN [{", ".join("'" + h + "'" for h in _HEADLINES)}][CAST(doc_id // 2 % {len(_HEADLINES)} AS INTEGER) + 1] ELSE coalesce(text, '') END, '\s+', ' ', 'g')), {claims.LENGTH})) AS t,
         CASE WHEN doc_id % 7 > 0 THEN strftime(make_timestamp(CAST((1782900000 + (doc_id % 5) * 21600 + 28800) * 1000000 AS BIGINT)), '%Y-%m-%d') END AS day
  FROM documents),
a AS (
  SELECT *, {_NAMED} AS named, CASE WHEN {_says(V.WAR)} AND {_says(V.WAR_DENIED)} THEN 'war_denial' ELSE coalesce(CASE WHEN {_says(V.NEGATION)} THEN {_first(V.DENIED)} END, {_first([r for r in V.ACTIONS if r[0] != "rate_hold"])}) END AS action,
         list_transform(regexp_extract_all(t, '{_re2(titles.POINTS)}', 1), lambda x: {_NUMBER} || 'bp') AS points, list_transform(regexp_extract_all(t, '{_re2(titles.PARTS)}', 1), lambda x: {_NUMBER} || 'pct') AS parts,
         list_filter([{", ".join(f"CASE WHEN {_says(p)} THEN '{name}' END" for name, p in V.ENTITIES)}], lambda v: v IS NOT NULL) AS known,
         CASE WHEN {_says(V.REASONING)} THEN ['reasoning_model'] WHEN {_says(V.MODEL)} THEN ['model'] ELSE [] END AS kind, {_SEVERAL} AS several
  FROM x),
f AS (
  SELECT *, list_concat(list_concat(points, parts), list_concat(kind, list_transform(regexp_extract_all(t, '(?i)\b(?:gpt|claude|gemini|llama|iphone|cuda)[- ]?[a-z0-9.]+'), lambda n: replace(n, ' ', '-')))) AS things,
         NOT ({_says(V.MODAL)} OR {_says(V.INFINITIVE)} OR several > 1 OR (several > 0 AND {_says(V.HISTORICAL)})) AND ({_SURE}) AS sure
  FROM a),
w AS (
  SELECT *, CASE WHEN action LIKE 'rate%' THEN list_filter(known, lambda k: k IN ('fed', 'pboc')) WHEN action = 'war_denial' THEN CASE WHEN list_contains(known, 'vance') AND list_contains(known, 'iran') THEN list_filter(known, lambda k: k IN ('vance', 'trump', 'iran', 'israel')) ELSE [] END
         WHEN action LIKE 'holding%' THEN CASE WHEN len(known) > 0 THEN list_concat(known, ['kol:powell']) ELSE [] END ELSE known END AS who,
         CASE WHEN action LIKE 'rate%' THEN list_concat(points, list_concat(parts, ['policy_rate'])) WHEN action = 'war_denial' THEN list_concat(points, list_concat(parts, ['iran_conflict'])) WHEN action LIKE 'holding%' THEN list_concat(points, parts) ELSE things END AS details
  FROM f),
s AS (
  SELECT doc_id, named, action, CASE WHEN day IS NOT NULL AND sure AND len(who) > 0 AND (action LIKE 'holding%' OR len(details) > 0)
         THEN day || '|' || action || '|' || array_to_string(list_sort(list_distinct(who)), ',') || '|' || array_to_string(list_sort(list_distinct(details)), ',') END AS signature
  FROM w)"""
SQL = {
    "semantic_signatures": f"WITH {_SIGNED} SELECT * FROM s",
    "signature_clusters": f"WITH {_SIGNED} SELECT signature, min(doc_id) AS base_id, count(*) AS members FROM s WHERE signature IS NOT NULL GROUP BY 1",
}
