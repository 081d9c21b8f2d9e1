"""Policy notices: how much they may matter, what they touch, what kind they are; openings that extreme prices give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import once

#: Words anywhere in a text, inside others too; for each set of words the tickers and sectors to look at; categories that are taken as given. Fixed values.
HIGH = ("rate decision", "fomc", "emergency", "sanction", "tariff", "intervention", "downgrade", "default", "降息", "加息", "制裁", "关税", "干预", "降准", "违约", "评级下调")
MEDIUM = ("inflation", "employment", "guidance", "outlook", "speech", "minutes", "通胀", "就业", "讲话", "纪要", "展望", "政策")
TOUCHED = (
    (("rate", "fomc", "interest", "降息", "加息", "利率", "lpr"), ("TLT", "SPY"), ("美债", "利率敏感板块")), (("inflation", "cpi", "通胀", "物价"), ("TIP", "GLD"), ("通胀受益板块",)),
    (("tariff", "trade", "关税", "贸易", "出口管制", "sanction", "制裁"), ("SOXL", "FXI"), ("半导体", "跨境贸易链")), (("employment", "payroll", "jobless", "就业", "非农"), ("SPY",), ("消费", "周期股")),
    (("yuan", "renminbi", "人民币", "汇率", "外汇"), ("CNY=X", "FXI"), ("中概股", "出口链")), (("bank", "liquidity", "银行", "流动性", "存款保险"), ("KRE",), ("区域银行", "信用市场")), (("housing", "real estate", "房地产", "楼市"), ("XHB",), ("地产链",)),
)
CATEGORIES = ("fomc_statement", "fomc_minutes", "fed_press_release", "fed_speech", "pboc_announcement", "policy_update")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def severity(text: Column) -> Column:
    """high, medium or low."""
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.when(_any(t, HIGH), "high").when(_any(t, MEDIUM), "medium").otherwise("low"))


def touched(text: Column) -> Column:
    """(tickers, sectors), each once, in the order of the rules."""

    def of(t: Column) -> Column:
        part = lambda k: F.array_distinct(F.flatten(F.array_compact(F.array(*[F.when(_any(t, rule[0]), F.array(*map(F.lit, rule[k]))) for rule in TOUCHED]))))
        return F.struct(part(1).alias("tickers"), part(2).alias("sectors"))

    return once(F.lower(F.coalesce(text, F.lit(""))), of)


def category(given: Column, title: Column, source: Column, url: Column) -> Column:
    """The category as given if it is known, else by where the notice comes from and what it says."""
    text = lambda c: F.coalesce(c, F.lit(""))
    named, place, at = F.trim(text(source)), F.lower(F.trim(text(source))), F.lower(text(url))
    whole, stated = F.lower(F.concat_ws(" ", text(title), named, text(url))), F.lower(F.trim(text(given)))
    fomc = F.contains(whole, F.lit("fomc"))
    return (
        F.when(stated.isin(*CATEGORIES), stated).when(F.contains(whole, F.lit("pbc.gov.cn")) | F.contains(named, F.lit("中国人民银行")), F.when(F.contains(at, F.lit("pbc.gov.cn")), "pboc_announcement").otherwise("policy_update"))
        .when(F.contains(place, F.lit("speech")) | F.contains(at, F.lit("/newsevents/speech/")), "fed_speech")
        .when(_any(whole, ("minutes", "纪要")) & (fomc | F.contains(whole, F.lit("federal open market committee"))), "fomc_minutes").when(fomc & _any(whole, ("statement", "声明")), "fomc_statement")
        .when(_any(place, ("federal reserve", "fomc")), "fed_press_release").otherwise("policy_update")
    )


#: Names, assets and terms of the openings. Fixed values.
STOCKS, BANKS, GOLD, EXPORTS = "美股大盘 (SPY/QQQ)", "金融股 / 周期股", "黄金 (IAU/GLD)", "出口型企业 / 美元计价资产"


def opportunities(vix: Column, curve: Column, gold: Column, gold_change: Column, usd_cny: Column) -> Column:
    """(kind, asset, confidence, timeframe) of each opening: panic, a curve that comes back, a fall of gold, a weak yuan."""
    one = lambda kind, asset, confidence, time: F.struct(F.lit(kind).alias("kind"), F.lit(asset).alias("asset"), F.lit(confidence).alias("confidence"), F.lit(time).alias("timeframe"))
    return F.array_compact(F.array(
        F.when(vix > 35, one("panic_buying", STOCKS, "high", "中长期 (6-12个月)")).when(vix > 28, one("panic_buying", STOCKS, "medium", "中长期 (3-6个月)")), F.when((curve > -0.2) & (curve < 0.3), one("curve_normalization", BANKS, "medium", "中期 (1-3个月)")),
        F.when((gold != 0) & (gold_change < -2), one("dip_buying", GOLD, "medium", "中长期 (3-12个月)")), F.when(usd_cny > 7.20, one("currency_tailwind", EXPORTS, "medium", "短期 (1-3个月)")),
    ))
