"""Assets, taxonomies, sections, tiers, hashes and small scores as columns. Word lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import has_any, has_word
from .binding import once

#: Asset to the names it has in texts. Fixed values.
ALIASES = (
    ("US:NVDA", ("nvidia", "英伟达", "辉达")), ("US:TSM", ("tsmc", "台积电")), ("US:TSLA", ("tesla", "特斯拉")), ("US:AAPL", ("apple inc", "苹果公司")), ("US:MSFT", ("microsoft", "微软")),
    ("US:META", ("meta platforms", "facebook", "脸书", "元宇宙公司meta")), ("US:GOOGL", ("alphabet", "google", "谷歌")), ("US:AMZN", ("amazon", "亚马逊")),
    ("US:AMD", ("advanced micro devices", "超威半导体")), ("US:AVGO", ("broadcom", "博通")), ("US:BABA", ("alibaba", "阿里巴巴")), ("CRYPTO:BTC", ("bitcoin", "比特币")), ("CRYPTO:ETH", ("ethereum", "以太坊")),
    ("COMMODITY:GOLD", ("gold", "黄金", "金价")), ("COMMODITY:OIL", ("crude oil", "wti", "原油", "石油")), ("FX:DXY", ("dollar index", "美元指数", "dxy")),
    ("FX:USD/CNY", ("usd/cny", "美元兑人民币", "人民币汇率", "出口型企业", "美元计价资产")), ("US:UUP", ("dollar assets", "美元资产", "美元计价资产", "出口型企业")), ("INDEX:VIX", ("vix", "恐慌指数")),
    ("US:SPY", ("s&p 500", "s&p500", "标普500", "美股大盘")), ("US:QQQ", ("nasdaq 100", "nasdaq-100", "纳斯达克100")), ("BOND:UST_LONG", ("us treasuries", "us treasury", "美国国债", "长期美债")),
    ("FX:JPY", ("japanese yen", "yen", "日元")), ("INDEX:NIKKEI", ("nikkei", "日经")), ("THEME:EMERGING_MARKETS", ("emerging markets", "新兴市场")),
    ("THEME:GLOBAL_RISK_ASSETS", ("global risk assets", "全球风险资产", "所有风险资产", "所有资产", "风险资产")), ("THEME:AI", ("artificial intelligence", "人工智能", "ai")), ("US:XLF", ("financial stocks", "金融股")),
    ("US:XLI", ("cyclical stocks", "周期股")), ("THEME:SEMICONDUCTOR", ("semiconductor", "semiconductors", "半导体", "芯片")), ("THEME:FINANCIALS", ("financial stocks", "金融股", "银行股", "区域银行")),
    ("THEME:CHINA_EQUITY", ("a股", "中国股票", "中概股")), ("THEME:CRYPTO", ("crypto market", "加密货币市场", "加密资产")),
)
PREFIXES = ("US", "CN", "CRYPTO", "COMMODITY", "FX", "INDEX", "BOND", "THEME")
#: Symbol to the asset that it means. Fixed values.
SYMBOLS = {
    "BTC": "CRYPTO:BTC", "BTCUSD": "CRYPTO:BTC", "BTC-USD": "CRYPTO:BTC", "BITCOIN": "CRYPTO:BTC", "ETH": "CRYPTO:ETH", "ETHUSD": "CRYPTO:ETH", "ETH-USD": "CRYPTO:ETH", "ETHEREUM": "CRYPTO:ETH",
    "DOGE": "CRYPTO:DOGE", "DOGEUSD": "CRYPTO:DOGE", "DOGE-USD": "CRYPTO:DOGE", "SOL": "CRYPTO:SOL", "SOLUSD": "CRYPTO:SOL", "SOL-USD": "CRYPTO:SOL", "ADA": "CRYPTO:ADA", "XRP": "CRYPTO:XRP", "BNB": "CRYPTO:BNB",
    "GOLD": "COMMODITY:GOLD", "GLD": "COMMODITY:GOLD", "IAU": "COMMODITY:GOLD", "WTI": "COMMODITY:OIL", "OIL": "COMMODITY:OIL", "USO": "COMMODITY:OIL", "DXY": "FX:DXY", "UUP": "US:UUP",
    "CNY": "FX:USD/CNY", "USDCNY": "FX:USD/CNY", "USD/CNY": "FX:USD/CNY", "VIX": "INDEX:VIX", "TLT": "BOND:UST_LONG", "IEF": "BOND:UST_INTERMEDIATE",
}
#: Capitals before `stock` or `shares` that are no tickers. Fixed values.
STOP_TICKERS = ("A", "AI", "CEO", "CFO", "ETF", "GDP", "IPO", "SEC", "THE", "US", "USD")
TICKER = r"\$[A-Z]{1,5}\b|\b[A-Z][A-Z0-9.-]{0,5}\s+(?:(?:class\s+[A-Z]\s+|common\s+)?stock|shares?)\b"


def asset_key(value: Column) -> Column:
    """PREFIX:BODY in capitals; special symbols by their table, six digits (with or without their exchange) a Chinese share, a ticker or share class a US one; else null."""

    def of(v: Column) -> Column:
        bare = F.regexp_replace(v, r"^\$+", "")
        special = F.element_at(F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair]), bare)
        code = F.regexp_extract(bare, r"^(?:(?:SH|SZ|BJ)[.:]?)?([0-9]{6})(?:\.(?:SH|SZ|BJ))?$", 1)
        return (
            F.when(v.rlike("^(?:" + "|".join(PREFIXES) + "):."), v).when(special.isNotNull(), special).when(code != "", F.concat(F.lit("CN:"), code))
            .when(bare.rlike(r"^[A-Z][A-Z0-9]{0,5}(?:[.-][A-Z])?$"), F.concat(F.lit("US:"), bare))
        )

    return once(F.replace(F.upper(F.regexp_replace(F.trim(value), r"^[()\[\]{},;，；]+|[()\[\]{},;，；]+$", "")), F.lit(" "), F.lit("")), of)


def assets(text: Column, explicit: Column, most: int = 32) -> Column:
    """Distinct assets of a text in order: the explicit ones, cash tags, six-digit codes, names."""
    known = lambda values: F.filter(F.transform(values, asset_key), lambda x: x.isNotNull())
    tags = F.regexp_extract_all(text, F.lit(r"\$([A-Za-z][A-Za-z0-9.-]{0,9})\b"), 1)
    codes = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{6})(?![0-9])"), 1), lambda x: F.concat(F.lit("CN:"), x))
    named = once(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(has_any(low, names), F.lit(key)) for key, names in ALIASES])))
    return F.slice(F.array_distinct(F.concat(known(explicit), known(tags), codes, named)), 1, most)


def tickers(text: Column, most: int = 8) -> Column:
    """Distinct tickers in order of their first place: $TICKER, or TICKER stock or shares unless it is a stop word."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({TICKER})"), 1), lambda m: F.regexp_extract(m, r"^(\$?[A-Z][A-Z0-9.-]{0,5})", 1))
    kept = F.filter(found, lambda w: ~w.isin(*STOP_TICKERS))
    return F.slice(F.array_distinct(F.transform(kept, lambda w: F.replace(w, F.lit("$"), F.lit("")))), 1, most)


def source_tier(official: Column, own_post: Column, has_link: Column) -> Column:
    return F.when(official, "official").when(own_post, "first_party").when(has_link, "reporting").otherwise("discovery")


def substring_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur anywhere, inside other words too."""
    return sum((F.when(F.contains(F.lower(text), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


#: Weights of a signal's five marks, levels by their least score. Fixed values.
MARKS = (0.35, 0.25, 0.20, 0.10, 0.10)
SIGNAL_LEVELS = ((85, "CRITICAL"), (70, "HIGH"), (50, "MEDIUM"))


def signal_score(relevance: Column, impact: Column, timeliness: Column, credibility: Column, uniqueness: Column) -> Column:
    """Weighted sum of five marks from 0 to 100, to one place. Rounded in whole ten-thousandths, halves up, which no order of additions moves."""
    total = sum((m.cast("double") * w for m, w in zip((relevance, impact, timeliness, credibility, uniqueness), MARKS, strict=True)), F.lit(0.0))
    return F.floor((F.round(total * 10000) + 500) / 1000) / 10


def signal_level(score: Column) -> Column:
    out = F.lit("LOW")
    for least, name in reversed(SIGNAL_LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def input_hash(columns: list[Column]) -> Column:
    """Digest of the fields an opinion was formed on; nulls and empty strings differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
