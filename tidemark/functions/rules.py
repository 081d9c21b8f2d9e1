"""Rule tables as columns: topics, stance, horizon, assets, scores. Word lists are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import once

TOPICS = (
    ("ai_semiconductors", ("ai", "人工智能", "半导体", "芯片", "gpu", "算力", "data center")),
    ("monetary_policy", ("fed", "federal reserve", "美联储", "央行", "降息", "加息", "利率")),
    ("recession_growth", ("recession", "hard landing", "衰退", "硬着陆", "经济增长", "通缩")),
    ("inflation", ("inflation", "cpi", "通胀", "物价")),
    ("geopolitics_trade", ("war", "conflict", "tariff", "sanction", "战争", "冲突", "关税", "制裁")),
    ("crypto", ("bitcoin", "ethereum", "crypto", "比特币", "以太坊", "加密货币")),
    ("financial_system", ("credit", "liquidity", "bank", "debt", "信用", "流动性", "银行", "债务")),
    ("china_markets", ("china", "chinese", "中国", "人民币", "a股", "中概股")),
    ("market_risk", ("market", "equity", "stock", "vix", "市场", "股票", "美股", "风险资产")),
)
POSITIVE = ("bullish", "buy", "upside", "outperform", "benefit", "opportunity", "positive", "看好", "买入", "增持", "利好", "受益", "上涨", "机会", "逢低配置")
NEGATIVE = (
    "bearish", "sell", "downside", "underperform", "avoid", "warning", "risk", "crash", "collapse", "negative",
    "看空", "卖出", "减持", "利空", "下跌", "警告", "风险", "危机", "崩盘", "破裂",
)
NEGATED = ("不", "并不", "不再", "不要", "别")
#: Horizon to the words that tell it, in the order they are tried.
HORIZONS = (("long", ("中长期", "长期", "year", "年度")), ("medium", ("中期", "quarter", "季度")), ("short", ("短期", "day", "week", "天", "周")))
UNCERTAIN = ("不确定", "unknown", "随时")
#: Age in days up to which an edge has a freshness.
FRESHNESS = ((1, 1.0), (3, 0.9), (7, 0.75), (30, 0.5), (90, 0.25))
WEIGHTS = {"strength": 0.20, "confidence": 0.20, "freshness": 0.15, "corroboration": 0.15, "market": 0.20, "coverage": 0.10}
STRENGTH_BY_IMPACT = {"low": 0.05, "medium": 0.15, "high": 0.30, "severe": 0.40, "catastrophic": 0.50}


def is_latin(word: str) -> bool:
    return any(c.isascii() and c.isalnum() for c in word)


def any_word(words: tuple[str, ...]) -> str:
    """A pattern on lower-cased text: words with ASCII letters or digits stand between other characters than those, the others anywhere."""
    latin, other = [w for w in words if is_latin(w)], [w for w in words if not is_latin(w)]
    return "|".join([f"(?:^|[^a-z0-9])(?:{'|'.join(latin)})(?:$|[^a-z0-9])"] * bool(latin) + other)


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words occurs anywhere."""
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def has_any(low: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text has one of the words. A plain search comes first: few texts have the letters at all, and a pattern costs far more."""
    return holds(low, words) & low.rlike(any_word(words))


def has_word(text: Column, word: str) -> Column:
    """Whether the word stands in the text between characters that aren't letters or digits of ASCII."""
    return F.lower(text).rlike(rf"(^|[^a-z0-9]){word}($|[^a-z0-9])")


def topic(text: Column) -> Column:
    """The first topic one of whose words the text has, else general."""

    def of(low: Column) -> Column:
        out = F.lit("general")
        for name, words in reversed(TOPICS):
            out = F.when(has_any(low, words), name).otherwise(out)
        return out

    return once(F.lower(F.coalesce(text, F.lit(""))), of)


def negation(word: str) -> str:
    """A pattern of what negates the word: not, never or no up to two words before it, or a fixed prefix."""
    letter = r"[\p{L}\p{N}_]"
    if is_latin(word):
        return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:not|never|no)\s+(?:{letter}+\s+){{0,2}}{word}(?:$|[^\p{{L}}\p{{N}}_])"
    return "|".join(p + word for p in NEGATED)


def _hits(low: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text has and nowhere negates."""
    return sum((F.when(has_any(low, (w,)) & ~low.rlike(negation(w)), 1).otherwise(0) for w in words), F.lit(0))


def stance(text: Column) -> Column:
    def of(low: Column) -> Column:
        hits = F.struct(_hits(low, POSITIVE).alias("good"), _hits(low, NEGATIVE).alias("bad"))
        return once(hits, lambda h: F.when(h["good"] > h["bad"], "bullish").when(h["bad"] > h["good"], "bearish").otherwise("unknown"))

    return once(F.lower(F.coalesce(text, F.lit(""))), of)


def horizon(text: Column) -> Column:
    """short, medium, long or unknown: a span of months by its end, else by keyword."""

    def of(low: Column) -> Column:
        months = F.regexp_extract(low, r"[0-9]+\s*[-–—至到]\s*([0-9]+)\s*个?月", 1)
        end = months.try_cast("int")
        by_word = F.lit("unknown")
        for name, words in reversed(HORIZONS):
            by_word = F.when(holds(low, words), name).otherwise(by_word)
        known = F.when(months != "", F.when(end <= 3, "short").when(end <= 6, "medium").otherwise("long")).otherwise(by_word)
        return F.when((low == "") | holds(low, UNCERTAIN), "unknown").otherwise(known)

    return once(F.lower(F.trim(F.coalesce(text, F.lit("")))), of)


def confidence(has_asset: Column, stance_: Column, topic_: Column, is_event: Column) -> Column:
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    total = F.lit(0.30) + flag(has_asset, 0.25) + flag(stance_ != "unknown", 0.20) + flag(topic_ != "general", 0.10) + flag(is_event, 0.05)
    capped = F.least(total, F.lit(0.95))
    return F.round(F.when(stance_ == "unknown", F.least(capped, F.lit(0.45))).otherwise(capped), 2)


def strength(impact: Column, direction: Column, is_event: Column) -> Column:
    by = F.lit(0.0)
    for name, w in STRENGTH_BY_IMPACT.items():
        by = F.when(impact == name, w).otherwise(by)
    total = F.when(is_event, 0.30).otherwise(0.45) + by + F.when(direction != "neutral", 0.15).otherwise(0.0)
    return F.round(F.least(total, F.lit(1.0)), 2)


def freshness(age_days: Column) -> Column:
    """By age: a step function; unknown .35, over five minutes ahead 0."""
    out = F.lit(0.1)
    for limit, value in reversed(FRESHNESS):
        out = F.when(age_days <= limit, value).otherwise(out)
    return F.when(age_days.isNull(), 0.35).when(age_days < -5.0 / 1440, 0.0).otherwise(out)


def corroboration(sources: Column) -> Column:
    return F.when(sources >= 4, 1.0).when(sources == 3, 0.85).when(sources == 2, 0.65).when(sources == 1, 0.35).otherwise(0.0)


def public_impact(rule: Column, level: Column, sure: Column, current: Column) -> Column:
    """A rule's impact, moved by a current opinion of level and confidence: medium either way, low up to medium."""
    heard = current & (sure >= 0.65)
    medium = F.when(heard & (level == "high"), "high").when(heard & (level == "none"), "low").otherwise("medium")
    low = F.when(heard & level.isin("high", "medium"), "medium").otherwise("low")
    return F.when(rule == "high", "high").when(rule == "medium", medium).otherwise(low)


def heat(rank: Column, score: Column, comments: Column, age_hours: Column, both: Column) -> Column:
    """Engagement of a ranked story, fading by half in eight hours, 0 to 100."""
    share = lambda x, top: F.least(F.lit(1.0), F.log1p(x) / F.log1p(F.lit(float(top))))
    e = 35 / (1 + 0.08 * (rank - 1)) + 20 * share(score, 500) + 15 * share(comments, 250) + F.when(both, 10.0).otherwise(0.0)
    fade = F.pow(F.lit(2.0), -age_hours / 8)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), e * (0.35 + 0.65 * fade) + 20 * fade)), 1)


def steps(value: Column, table: tuple[tuple[float, float], ...]) -> Column:
    """Points of the first limit that a value exceeds, limits from the highest; 0 for none and for null."""
    out = F.lit(0)
    for limit, points in reversed(table):
        out = F.when(value > limit, points).otherwise(out)
    return out


def recession_score(vix: Column, curve: Column, stress: Column) -> Column:
    below = F.when(curve < -0.4, 25).when(curve < 0, 15).when(curve < 0.3, 5).otherwise(0)
    return F.least(F.lit(100), 30 + steps(vix, ((35, 30), (28, 20), (20, 10))) + below + steps(stress, ((5, 25), (2, 15), (0, 5))))


def stress_score(vix: Column, dollar: Column, dollar_change: Column, stress: Column) -> Column:
    moved = F.when(F.abs(dollar_change) > 1, 10).otherwise(0)
    return F.least(F.lit(100), 20 + steps(vix, ((35, 25), (28, 15), (20, 5))) + steps(dollar, ((108, 20), (105, 10))) + moved + steps(stress, ((5, 15), (2, 10), (0, 5))))


def geopolitics_score(high: Column, medium: Column) -> Column:
    return F.least(F.lit(100), 20 + F.when(high >= 3, 35).when(high >= 1, 20).otherwise(0) + F.when(medium >= 5, 15).when(medium >= 2, 5).otherwise(0))


def china_score(usd_cny: Column, policy_word: Column) -> Column:
    rate = steps(usd_cny, ((7.30, 30), (7.20, 20), (7.10, 10))) - F.when(usd_cny < 6.80, 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 25 + rate + F.when(policy_word, 10).otherwise(0)))


def composite(recession: Column, market: Column, geopolitics: Column, china: Column) -> Column:
    """The whole number nearest to the weighted sum, halves to the even one."""
    return F.bround(0.30 * recession + 0.25 * market + 0.20 * geopolitics + 0.25 * china, 0).cast("int")


def risk_level(score: Column, limits: tuple[float, float, float] = (70, 55, 40)) -> Column:
    return F.when(score >= limits[0], "critical").when(score >= limits[1], "high").when(score >= limits[2], "medium").otherwise("low")
