"""Queries on redacted payloads, on snapshots that are judged before they come in, and on yield curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_walk
from ..operators import imports
from ..sources import payloads
from ..sources.tables import table

_BEFORE = ("my portfolio and Account: ", "accounting for shareholders, ", "the cost of 5 shares, shares ", "")
_SOURCES = ("acct/account/7", "US:COST", "plain-id", "portfolio")


def redacted_payloads(spark, d):
    """Turns as nested payloads with private keys and words, as they may be shown."""
    turn = F.col("turn")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (turn % len(words)).cast("int"))
    text = F.concat(pick(_BEFORE), F.coalesce("text", F.lit("")))
    leg = F.struct(text.alias("note"), turn.alias("Quantity"), F.struct(F.col("conv_id").alias("n"), F.lit(1).alias("my_shares_held")).alias("inner"))
    payload = F.to_json(F.struct(pick(_SOURCES).alias("source_id"), pick(_SOURCES).alias("asset_key"), F.lit(1).alias("avg_cost"), F.struct(text.alias("title"), F.array(leg, leg).alias("legs")).alias("detail")))
    rows = table(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", json_walk.redacted(payload).alias("p"))
    field = lambda path, name: F.get_json_object("p", f"$.{path}").alias(name)
    return rows.select(
        "conv_id", "turn", field("source_id", "source_id"), field("asset_key", "asset_key"), field("detail.title", "title"), field("detail.legs[1].note", "note"),
        F.array_join(F.json_object_keys("p"), ",").alias("keys"), F.array_join(F.json_object_keys(F.get_json_object("p", "$.detail.legs[1]")), ",").alias("leg_keys"), field("detail.legs[0].inner", "inner"),
    )


def import_verdicts(spark, d):
    """A file a page with one item; most have a fault of some kind."""
    k = F.col("page_id") % 9
    item = F.struct(
        F.when(k == 1, F.lit("!?")).otherwise(F.concat(F.lit("Page "), "page_id")).alias("title"), F.when(k == 2, F.lit("file:///etc/x")).otherwise(F.concat(F.lit("https://e.com/"), "page_id")).alias("source_url"), F.when(k == 3, "rumour").otherwise("media").alias("source_tier"),
        F.when(k == 4, F.lit(None)).otherwise(F.lit("2026-06-30T20:00:00Z")).alias("published_at"), F.when(k == 5, F.lit(1)).alias("odd"),
    )
    lists = F.struct(*[(F.array(item) if s == "ai" else F.array().cast("array<string>")).alias(s) for s in imports.SECTIONS])
    whole = F.struct(F.lit(1).alias("schema_version"), F.when(k == 6, "2026-06-29").otherwise("2026-07-01").alias("snapshot_date"), F.lit("2026-07-01T08:00:00+08:00").alias("generated_at"), F.lit("2026-06-30T23:50:00Z").alias("source_as_of"), lists.alias("sections"))
    text = F.to_json(whole)
    body = F.when(k == 7, F.concat(F.left(text, F.length(text) - 1), F.lit(',"sections":{}}'))).when(k == 8, F.left(text, F.length(text) - 1)).otherwise(text)
    files = table(spark, d, "pages", "page_id").select(F.col("page_id").cast("string").alias("file"), body.alias("body"))
    rows = imports.checked(files, F.lit("2026-07-01 00:10:00").cast("timestamp"))
    items = imports.items_of(rows).groupBy("file").agg(F.count("*").alias("items"))
    return rows.select("file", "reason").join(items, "file", "left").select("file", "reason", F.coalesce("items", F.lit(0)).alias("items"))


def treasury_yields(spark, d):
    """A feed a month of orders: each day's largest order as its curve; some days lack a tenor, some months have none."""
    o = table(spark, d, "orders", "o_orderdate", "o_totalprice")
    days = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("v"))
    k, month = F.dayofmonth("day"), F.date_format("day", "yyyy-MM")
    tag = lambda name, scale, cond: F.when(cond & (F.month("day") != 7), F.concat(F.lit(f"<d:{name} m:type='x'>"), F.format_number(F.col("v") / scale, 4).alias("n"), F.lit(f"</d:{name}>"))).otherwise(F.lit(""))
    entry = F.concat(F.lit("<entry><d:NEW_DATE>"), F.date_format("day", "yyyy-MM-dd"), F.lit("T00:00:00</d:NEW_DATE>"), tag("BC_2YEAR", 100_000, k % 2 == 0), tag("BC_10YEAR", 90_000, k % 5 > 0), tag("BC_30YEAR", 80_000, F.month("day") % 2 == 0), F.lit("</entry>"))
    bodies = days.groupBy(month.alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", entry.alias("e")))), lambda x: x["e"]), "\n").alias("body"))
    y = lambda t: F.element_at("yields", t)
    return payloads.treasury_yields(bodies).select("source", "as_of", y("2Y").alias("y2"), y("10Y").alias("y10"), y("30Y").alias("y30"), "status")


QUERIES = {f.__name__: f for f in (redacted_payloads, import_verdicts, treasury_yields)}
_WORDS = "|".join(json_walk.IN_TEXT)


def _shown(text: str) -> str:
    # Twice, as neighbours share the letter between them.
    once = lambda t: f"regexp_replace({t}, '(?i)(^|[^A-Za-z])({_WORDS})($|[^A-Za-z])', '\\1[redacted]\\3', 'g')"
    return once(once(text))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_NAMED = "'[redacted]-' || left(sha256('{}' || chr(0) || s), 16)"
SQL = {
    "redacted_payloads": f"""
WITH x AS (SELECT conv_id, turn, {_list(_BEFORE)}[turn % 4 + 1] || coalesce(text, '') AS t, {_list(_SOURCES)}[turn % 4 + 1] AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 4 <> 2 THEN {_NAMED.format("source_id")} ELSE s END AS source_id, CASE WHEN turn % 4 IN (0, 3) THEN {_NAMED.format("asset_key")} ELSE s END AS asset_key,
       {_shown("t")} AS title, {_shown("t")} AS note, 'source_id,asset_key,detail' AS keys, 'note,inner' AS leg_keys, '{{"n":' || conv_id || '}}' AS inner FROM x""",
    "import_verdicts": """
SELECT CAST(page_id AS VARCHAR) AS file, [NULL, 'sections.ai[0].title has no searchable content', 'sections.ai[0].source_url must be a public http url', 'sections.ai[0].source_tier must be one of official, first_party, media, discovery',
  'sections.ai[0] requires published_at or fetched_at', 'sections.ai[0] contains unsupported fields: odd', 'snapshot_date must match generated_at in Asia/Shanghai', 'duplicate JSON key: sections', 'payload must be an object'][page_id % 9 + 1] AS reason,
  CAST(page_id % 9 = 0 AS BIGINT) AS items FROM pages""",
    "treasury_yields": """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS v FROM orders GROUP BY 1),
m AS (
  SELECT strftime(day, '%Y-%m') AS source, CAST(max(day) AS VARCHAR) AS as_of, arg_max(v, day) FILTER (day(day) % 2 = 0 AND month(day) <> 7) AS a, arg_max(v, day) FILTER (day(day) % 5 > 0 AND month(day) <> 7) AS b,
         arg_max(v, day) FILTER (month(day) % 2 = 0) AS c FROM d GROUP BY 1)
SELECT source, as_of, round(round(a / 100000::DOUBLE, 4), 3) AS y2, round(round(b / 90000::DOUBLE, 4), 3) AS y10, round(round(c / 80000::DOUBLE, 4), 3) AS y30,
       CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 'unavailable' WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'partial' ELSE 'ready' END AS status FROM m""",
}
