"""States of readings and marks of stored rows as columns. Limits and texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import titles

#: A ticker in parentheses, of either width, and a tag that is nothing but a ticker.
IN_PARENTHESES, BARE = r"[（(]\s*([A-Z][A-Z0-9.\-]{0,5})\s*[)）]", r"^[A-Z][A-Z0-9.\-]{0,5}$"
#: Curve spread below which a status and its signal hold, in order.
CURVE = ((-0.4, "deep_inverted", "recession_warning"), (0.0, "inverted", "recession_watch"), (0.5, "flat", "uncertainty"), (1.5, "normal", "normal"))
#: What a card says of a market whose snapshot is too old, or ahead of the clock.
OLD, AHEAD = "宏观快照已超过90分钟，系统停止升级仓位动作。", "宏观快照时间异常，系统停止升级仓位动作。"
NOT_LOW, EXPIRED, OBSERVE, FRESHNESS = "这不是低风险结论。", "宏观采集快照已过期", "继续观察", "核心数据新鲜度"


def stress_status(value: Column) -> Column:
    """low, normal above 0, elevated above 2, critical above 5; a missing value is unknown, not calm."""
    return F.when(value.isNull(), "unknown").when(value > 5, "critical").when(value > 2, "elevated").when(value > 0, "normal").otherwise("low")


def curve(two: Column, ten: Column, thirty: Column) -> Column:
    """(status, signal, spread_2y10y, spread_10y30y) of three yields; a yield of zero counts as missing."""
    near, far = F.nullif(ten, F.lit(0)) - F.nullif(two, F.lit(0)), F.nullif(thirty, F.lit(0)) - F.nullif(ten, F.lit(0))
    status, signal = F.when(near.isNull(), "unknown"), F.when(near.isNull(), F.lit(None).cast("string"))
    for limit, name, sign in CURVE:
        status, signal = status.when(near < limit, name), signal.when(near < limit, sign)
    return F.struct(status.otherwise("steep").alias("status"), signal.otherwise("growth_expectation").alias("signal"), F.round(near, 3).alias("spread_2y10y"), F.round(far, 3).alias("spread_10y30y"))


def term_structure(spot: Column, following: Column) -> Column:
    """(status, contango) of an index and its next future; steep beyond two points either way."""
    gap = F.nullif(following, F.lit(0)) - F.nullif(spot, F.lit(0))
    status = F.when(gap.isNull(), "unknown").when(gap > 2, "contango_steep").when(gap > 0, "contango").when(gap > -2, "backwardation_mild").otherwise("backwardation_steep")
    return F.struct(status.alias("status"), F.round(gap, 2).alias("contango"))


def completeness(inputs: dict[str, Column]) -> Column:
    """(status, missing): ok, partial or unavailable, with the names of the inputs that are null."""
    missing = F.array_compact(F.array(*[F.when(value.isNull(), name) for name, value in inputs.items()]))
    status = F.when(F.size(missing) == 0, "ok").when(F.size(missing) == len(inputs), "unavailable").otherwise("partial")
    return F.struct(status.alias("status"), missing.alias("missing"))


def coverage_ratio(available: Column, total: Column) -> Column:
    """The share that is there, from 0 to 1; 0 where either count is missing or nothing was asked for."""
    return F.when((total > 0) & available.isNotNull(), F.round(F.least(F.greatest(available / total, F.lit(0.0)), F.lit(1.0)), 4)).otherwise(0.0)


def asset_tags(items: Column) -> Column:
    """(tickers, sectors) of an array of labels, each once by its first place: a ticker in parentheses leaves the rest of its label as a sector."""
    labels = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    inside = lambda x: F.regexp_extract(x, IN_PARENTHESES, 1)
    ticker = lambda x: F.when(inside(x) != "", inside(x)).when(x.rlike(BARE), x)
    sector = lambda x: F.when(inside(x) != "", F.trim(F.regexp_replace(x, IN_PARENTHESES, ""))).when(~x.rlike(BARE), x)
    both = (F.array_distinct(F.array_compact(F.transform(labels, ticker))), F.array_distinct(F.filter(F.transform(labels, sector), lambda x: x != "")))
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(both[0], none).alias("tickers"), F.coalesce(both[1], none).alias("sectors"))


def content_eligible(source: Column, url: Column, snippet: Column, title: Column, prose: tuple[Column, Column] | None = None) -> Column:
    """Whether a post has words of its own; asked only of the one network whose placeholders have none.

    prose: whether snippet and title are texts of another kind than posts. Such a text may begin with From or By, or have links, and these are words of its own.
    """
    mirrored = F.lower(F.coalesce(source, F.lit(""))).contains("truth social") | F.lower(F.coalesce(url, F.lit(""))).contains("truthsocial.com/")
    told = F.nullif(snippet, F.lit(""))
    words = F.coalesce(told, title)
    own = titles.substantive(words)
    if prose is not None:
        own = F.when(F.when(told.isNotNull(), prose[0]).otherwise(prose[1]), titles.lettered(words)).otherwise(own)
    return ~mirrored | F.coalesce(own, F.lit(False))


def expired(alert: Column, now: Column) -> Column:
    """An alert(generated_at, action, action_label, risk_level, abstain, data_status, summary, missing_sources, gates) as it may be shown now.

    More than 90 minutes old, or over five ahead of the clock, it only observes: the level insufficient, the freshness gate unavailable (added as the
    first where there is none), the reason told. gates are (key, label, status, detail). Null without a time.
    """
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(alert["generated_at"].cast("timestamp"))
    reason = F.when(age < -300, AHEAD).otherwise(OLD)
    gates = F.coalesce(alert["gates"], F.array().cast("array<struct<key:string,label:string,status:string,detail:string>>"))
    gate = lambda key, label: F.struct(key.alias("key"), label.alias("label"), F.lit("unavailable").alias("status"), reason.alias("detail"))
    # Only the first gate of that key changes.
    first = F.array_position(F.transform(gates, lambda g: g["key"]), "data_freshness")
    marked = F.transform(gates, lambda g, k: F.when(k + 1 == first, gate(g["key"], g["label"])).otherwise(g))
    shut = F.when(first > 0, marked).otherwise(F.concat(F.array(gate(F.lit("data_freshness"), F.lit(FRESHNESS))), gates))
    missing = F.coalesce(alert["missing_sources"], F.array().cast("array<string>"))
    now_missing = F.when(F.array_contains(missing, EXPIRED), missing).otherwise(F.array_append(missing, EXPIRED))
    good = age.between(-300, 90 * 60)
    kept = lambda name, value: F.when(good, alert[name]).otherwise(value).alias(name)
    return F.when(
        age.isNotNull(),
        F.struct(
            alert["generated_at"].alias("generated_at"), kept("action", F.lit("observe")), kept("action_label", F.lit(OBSERVE)), kept("risk_level", F.lit("insufficient")), kept("abstain", F.lit(True)),
            kept("data_status", F.lit("insufficient")), kept("summary", F.concat(reason, F.lit(NOT_LOW))), kept("missing_sources", now_missing), kept("gates", shut),
        ),
    )


def gate_progress(gates: Column) -> Column:
    return F.struct(F.size(F.filter(gates, lambda g: g["status"] == "met")).alias("met"), F.size(gates).alias("total"))
