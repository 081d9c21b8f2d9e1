"""Assets and their providers: symbols, proxies with lineage, benchmarks, and the instants that daily bars close at.

Everything is asked of the asset key `PREFIX:BODY`; one that isn't of this form has no symbol, proxy, benchmark or session.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import once

#: Symbols, price proxies of themes, benchmarks of themes and of other assets. Fixed values.
SYMBOLS = {
    "COMMODITY:GOLD": "GC=F", "COMMODITY:OIL": "CL=F", "FX:DXY": "DX-Y.NYB", "FX:USD/CNY": "CNY=X", "FX:JPY": "JPY=X", "FX:USD/JPY": "JPY=X", "FX:EUR/USD": "EURUSD=X", "INDEX:VIX": "^VIX", "INDEX:NIKKEI": "^N225",
    "INDEX:CSI300": "000300.SS", "BOND:UST_LONG": "TLT", "BOND:UST_INTERMEDIATE": "IEF", "BOND:UST_SHORT": "SHY", "BOND:UST_10Y_YIELD": "^TNX",
}
THEME_PRICES = {
    "THEME:AI": "US:SOXX", "THEME:SEMICONDUCTOR": "US:SOXX", "THEME:CHINA_EQUITY": "US:MCHI", "THEME:EMERGING_MARKETS": "US:EEM", "THEME:GLOBAL_RISK_ASSETS": "US:ACWI", "THEME:FINANCIALS": "US:XLF", "THEME:CRYPTO": "CRYPTO:BTC",
}
THEME_BENCHMARK = "US:SPY"
BENCHMARKS = {
    "COMMODITY:GOLD": "US:GLD", "COMMODITY:OIL": "US:USO", "FX:DXY": "US:UUP", "FX:USD/CNY": "FX:DXY", "FX:JPY": "FX:DXY", "FX:USD/JPY": "FX:DXY", "FX:EUR/USD": "FX:DXY", "INDEX:VIX": "US:VXX", "INDEX:NIKKEI": "US:EWJ",
    "INDEX:CSI300": "CN:510300", "BOND:UST_LONG": "US:IEF", "BOND:UST_INTERMEDIATE": "US:SHY", "BOND:UST_10Y_YIELD": "US:IEF",
}
CHIP_WORDS = ("ai", "semiconductor", "chip", "半导体", "芯片")
#: Local hour and minute at which sessions close, and the indexes that close with them. Fixed values.
CLOSES = {
    "America/Chicago": (15, 15), "America/New_York": (16, 0), "America/Toronto": (16, 0), "Asia/Shanghai": (15, 0), "Asia/Hong_Kong": (16, 0), "Asia/Tokyo": (15, 0), "Europe/London": (16, 30),
}
US_INDEXES, CN_INDEXES = ("INDEX:DOW", "INDEX:NASDAQ", "INDEX:SPX", "INDEX:VIX"), ("INDEX:CSI300",)
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def canonical(asset: Column) -> Column:
    """PREFIX:BODY in capitals; null if it isn't two parts."""
    whole = lambda parts: (F.size(parts) == 2) & (F.get(parts, 0) != "") & (F.get(parts, 1) != "")
    return once(F.transform(F.split(asset, ":"), lambda p: F.upper(F.trim(p))), lambda parts: F.when(whole(parts), F.concat_ws(":", parts)))


def _of(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _body(key: Column) -> Column:
    return F.substring_index(key, ":", -1)


def exchange(code: Column) -> Column:
    """SS, SZ or BJ of a six-digit Chinese code."""
    six = code.rlike(r"^\d{6}$")
    return F.when(~six, None).when(code.rlike("^(4|8|92)"), "BJ").when(code.rlike("^(5|6|9|110|113|118)"), "SS").when(code.rlike("^[0123]"), "SZ")


def symbol(asset: Column, provider: Column) -> Column:
    """The symbol of an asset at a provider (yahoo or tencent), without guessing; null if it has none there."""
    return once(canonical(asset), lambda key: _symbol(key, F.lower(F.trim(F.coalesce(provider, F.lit(""))))))


def _symbol(key: Column, name: Column) -> Column:
    def of(x: Column) -> Column:
        body, prefix, place = x["body"], x["prefix"], x["place"]
        listed = F.when(place == "SS", "sh").when(place == "SZ", "sz").when(place == "BJ", "bj")
        tencent = F.when(prefix == "CN", F.concat(listed, body))
        yahoo = (
            F.when(x["fixed"].isNotNull(), x["fixed"]).when((prefix == "US") & body.rlike(r"^[A-Z][A-Z0-9.-]{0,14}$"), F.replace(body, F.lit("."), F.lit("-")))
            .when((prefix == "CN") & place.isNotNull(), F.concat_ws(".", body, place)).when((prefix == "CRYPTO") & body.rlike("^[A-Z][A-Z0-9]{1,14}$"), F.concat(body, F.lit("-USD")))
        )
        return F.when(x["name"] == "yahoo", yahoo).when(x["name"] == "tencent", tencent)

    parts = F.struct(_body(key).alias("body"), F.substring_index(key, ":", 1).alias("prefix"), exchange(_body(key)).alias("place"), _of(key, SYMBOLS).alias("fixed"), name.alias("name"))
    return once(parts, of)


def resolved(asset: Column, provider: Column) -> Column:
    """(requested, price_asset, provider, symbol, proxy_for): a theme is priced by its proxy and says for what."""

    def of(x: Column) -> Column:
        key, name = x["key"], x["name"]
        return F.struct(
            F.coalesce(key, x["given"]).alias("requested"), x["price"].alias("price_asset"), F.when(key.isNull(), F.nullif(name, F.lit(""))).otherwise(name).alias("provider"), _symbol(x["price"], name).alias("symbol"),
            F.when(x["proxy"].isNotNull(), key).alias("proxy_for"),
        )

    def priced(x: Column) -> Column:
        proxy = _of(x["key"], THEME_PRICES)
        return once(F.struct(x["key"].alias("key"), x["name"].alias("name"), x["given"].alias("given"), proxy.alias("proxy"), F.coalesce(proxy, x["key"]).alias("price")), of)

    given = F.struct(canonical(asset).alias("key"), F.lower(F.trim(F.coalesce(provider, F.lit("")))).alias("name"), F.nullif(F.trim(asset), F.lit("")).alias("given"))
    return once(given, priced)


def benchmark(asset: Column, topic: Column) -> Column:
    """What an asset is compared with, null where nothing is justified."""

    def of(x: Column) -> Column:
        key, prefix = x["key"], F.substring_index(x["key"], ":", 1)
        chips = F.lit(False)
        for word in CHIP_WORDS:
            chips = chips | F.contains(x["low"], F.lit(word))
        return (
            F.when(key.isin(*THEME_PRICES), THEME_BENCHMARK).when(chips & (key != "US:SOXX"), "US:SOXX").when(prefix == "US", F.when(key != "US:SPY", "US:SPY")).when(prefix == "CN", "INDEX:CSI300")
            .when(prefix == "CRYPTO", F.when(_body(key) != "BTC", "CRYPTO:BTC")).otherwise(_of(key, BENCHMARKS))
        )

    return once(F.struct(canonical(asset).alias("key"), F.lower(F.trim(F.coalesce(topic, F.lit("")))).alias("low")), of)


def _local(seconds: Column, zone: Column) -> Column:
    """Wall-clock time in a zone, whatever the session's."""
    utc = F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.convert_timezone(F.lit("UTC"), zone, utc)


def _instant(day: Column, hour: Column, minute: Column, zone: Column) -> Column:
    """Seconds of a local time of a day; what daylight saving was on that day counts."""
    wall = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute, F.lit(0))
    return F.timestamp_diff("SECOND", F.expr(_EPOCH), F.convert_timezone(zone, F.lit("UTC"), wall))


def observed(seconds: Column, asset: Column, interval: Column, zone: Column) -> Column:
    """(at, basis): when a bar was observed, in seconds.

    A daily bar of a known session is of its local close, one of a currency of 17:00 in New York on its day in the provider's zone, and no bar (at is null) on a weekend;
    others, and those of a zone that isn't known, keep the provider's time.
    """
    key, name = F.upper(F.trim(F.coalesce(asset, F.lit("")))), F.coalesce(F.nullif(F.trim(zone), F.lit("")), F.lit("UTC"))
    known = name.isin(*sorted(available_timezones()))
    safe = F.when(known, name).otherwise("UTC")
    day = F.to_date(_local(seconds, safe))
    daily = F.lower(F.trim(F.coalesce(interval, F.lit("")))) == "1d"
    equity = (
        (key.startswith("US:") & (name == "America/New_York")) | (key.isin(*US_INDEXES) & name.isin("America/New_York", "America/Chicago"))
        | ((key.startswith("CN:") | key.isin(*CN_INDEXES)) & (name == "Asia/Shanghai"))
    )
    hour, minute = F.lit(0), F.lit(0)
    for place, (h, m) in CLOSES.items():
        hour, minute = F.when(name == place, h).otherwise(hour), F.when(name == place, m).otherwise(minute)
    currency = key.startswith("FX:") & known
    at = F.when(daily & currency, F.when(F.weekday(day) < 5, _instant(day, F.lit(17), F.lit(0), F.lit("America/New_York")))).when(daily & equity, _instant(day, hour, minute, safe)).otherwise(seconds)
    return F.struct(at.alias("at"), F.when(daily & (currency | equity), "market_close").otherwise("provider").alias("basis"))
