"""Rules against literal cases: what each gives for inputs worked out by hand from its rule card."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, signals, times, titles, urls
from tidemark.operators import performance, segments, stories


def given(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def check(spark, cases, rule, kind="string"):
    got = given(spark, [a for a, _ in cases], kind).select("i", rule(F.col("x")).alias("y")).collect()
    assert [r.y for r in sorted(got)] == [b for _, b in cases]


def test_canonical_url(spark):
    check(spark, [
        ("https://A.com/x/?utm_source=1&Ref=2&b=3&c=4#f", "https://a.com/x?b=3"), ("http://a.com", "http://a.com/"), ("http://a.com/?q=&z=1", "http://a.com/?z=1"),
        ("https://www.bing.com/news/apiclick.aspx?ref=FexRss&aid=&tid=1&url=https%3A%2F%2Fb.org%2Fp%2F%3Fid%3D7&c=9", "https://b.org/p?id=7"),
        ("https://r.com/?url=https://one.com/a&b=1&url=https://two.com/b", "https://one.com/a"), ("https://r.com/?url=&url=https://two.com/b", "https://two.com/b"),
        ("https://r.com/?u=https://q.com/?url=http%3A%2F%2Fc.net%2Fd", "http://c.net/d"), ("http://a.com/p?k=a+b%2Fc", "http://a.com/p?k=a+b%2Fc"), (None, ""), ("", ""),
    ], urls.canonical_url)


def test_titles(spark):
    check(spark, [("Ｆｅｄ　raises １％", "fedraises1"), ("A丨B", "ab"), ("Hello world now Hello wor", "helloworldnow"), ("abcabc", "abcabc"), (None, "")], titles.normal_title)
    check(spark, [("cut 25.0bp and 0.50 %, 25 bps", "0.5pct,25bp"), ("升 25个基点 或 3%", "25bp,3pct"), ("100 basis points", "100bp"), ("5 percent", "")], lambda x: F.array_join(titles.amounts(x), ","))
    check(spark, [("RT @a https://x.co/y", False), ("ok!", False), ("yes", True), ("$A", True), ("涨了", True), ("via @bob x.com/1 #tag", True), (None, False), ("www.a.org hi", False)], titles.substantive)


def test_times(spark):
    at = datetime.datetime(2026, 3, 4, 1, 29)
    stamps = [at, at + datetime.timedelta(minutes=1), at.replace(hour=7, minute=0), at.replace(hour=12, minute=30)]
    check(spark, list(zip(stamps, ["morning", "midday", "close", "us_premarket"], strict=True)), times.edition, "timestamp")
    hours = [(h, 9 <= h < 12 or 14 <= h < 18) for h in range(24)]
    base = datetime.datetime(2026, 3, 3, 16, 0)  # midnight of a Wednesday in Beijing
    check(spark, [(base + datetime.timedelta(hours=h), p) for h, p in hours], lambda x: times.peak(x, []), "timestamp")
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    check(spark, [("59m", 3600), ("60m", None), ("23 h", 86400), ("24h", None), ("0s", 1), ("yesterday", None), ("5 minutes ago", None)], lambda x: F.unix_seconds(now) - F.unix_seconds(times.relative(x, now)))
    stamp = lambda x: F.date_format(times.url_stamp(x), "yyyy-MM-dd HH:mm:ss")
    check(spark, [("http://p.cn/a/20240102093015123/b.html", "2024-01-02 01:30:15"), ("http://p.cn/20240102/b", None), ("http://p.cn/20241302093015/b", None), ("http://p.cn/20240102093015", None)], stamp)


def test_assets_and_tickers(spark):
    check(spark, [("brk.b", "US:BRK.B"), ("SH:600519", "CN:600519"), ("600519.ss", None), ("000001.SZ", "CN:000001"), ("$x", "US:X"), ("btc-usd", "CRYPTO:BTC"), ("us: tsm", "US:TSM"), ("us:", None), ("TOOLONG", None), (None, None), ("[gld]", "COMMODITY:GOLD")], signals.asset_key)
    check(spark, [("Buy $TSM now", "TSM"), ("NVDA shares and AI stock", "NVDA"), ("The CEO said GDP", ""), ("BRK.B class B stock, $A", "BRK.B,A")], lambda x: F.array_join(signals.tickers(x), ","))
    check(spark, [("gold, Bitcoin 和 芯片 $aapl 600519", "US:AAPL,CN:600519,CRYPTO:BTC,COMMODITY:GOLD,THEME:SEMICONDUCTOR")], lambda x: F.array_join(signals.assets(x, F.array().cast("array<string>")), ","))


def test_topic_stance_horizon(spark):
    check(spark, [("the Fed and AI", "ai_semiconductors"), ("said", "general"), ("关税", "geopolitics_trade"), ("warm bank", "financial_system"), (None, "general")], rules.topic)
    check(spark, [("buy", "bullish"), ("not a good buy", "unknown"), ("never buy, sell", "bearish"), ("buy and sell", "unknown"), ("不看好", "unknown"), ("看好", "bullish"), ("risky", "unknown")], rules.stance)
    check(spark, [("1-3个月", "short"), ("3 至 6 月", "medium"), ("6–12个月", "long"), ("this year", "long"), ("next quarter", "medium"), ("in days", "short"), ("unknown year", "unknown"), ("", "unknown")], rules.horizon)


def test_scores(spark):
    check(spark, [(62.5, "high"), (70.0, "critical"), (40.0, "medium"), (39.9, "low")], rules.risk_level, "double")
    row = spark.range(1).select(rules.composite(F.lit(75), F.lit(40), F.lit(20), F.lit(25)).alias("a"), signals.signal_score(*[F.lit(x) for x in (80, 60, 50, 40, 30)]).alias("b")).first()
    assert (row.a, row.b) == (43, 60.0)
    assert spark.range(1).select(signals.signal_level(F.lit(85.0))).first()[0] == "CRITICAL"


def test_trailing_growth_starts_on_or_after_its_day(spark):
    day = datetime.date
    points = [("s", day(2020, 1, 6), 90.0), ("s", day(2020, 1, 14), 100.0), ("s", day(2021, 1, 10), 121.0)]
    got = performance.trailing_growth(spark.createDataFrame(points, "series string, day date, value double"), (1, 3)).collect()
    assert [(r.years, r.start_day) for r in got] == [(1, day(2020, 1, 14)), (3, day(2020, 1, 6))]
    assert got[0].cagr == pytest.approx(1.21 ** (365.2425 / 362) - 1)


def test_titles_fold_into_the_longest(spark):
    rows = [(1, "a very long headline about"), (2, "a very long headline about rates"), (3, "a very long headline about rates today"), (4, "short one")]
    got = stories.fold_prefixes(spark.createDataFrame(rows, "item_id long, title string")).collect()
    assert {r.item_id: r.class_title for r in got} == {1: "averylongheadlineaboutratestoday", 2: "averylongheadlineaboutratestoday", 3: "averylongheadlineaboutratestoday", 4: "shortone"}


def test_order_of_sightings(spark):
    """Of unverified sightings the first seen last wins, whatever time they claim."""
    rows = [(1, "unknown", 9, 5), (2, "unknown", 1, 7), (3, "future", None, 6)]
    s = spark.createDataFrame(rows, "sighting_id long, time_status string, published_at long, first_seen long").selectExpr("*", "1 AS event_id", "false AS owned_direct", "first_seen AS last_seen")
    assert stories.best_per_group(s, ["event_id"], stories.sighting_order()).first().sighting_id == 2


def test_chunks_split_long_segments_first(spark):
    got = segments.chunks(spark.createDataFrame([("d", 0, "x" * 25), ("d", 1, "y" * 4), ("d", 2, ""), ("d", 3, "z" * 2)], "doc string, at long, text string"), 10).collect()
    assert sorted((r.at, r.part, r.chunk) for r in got) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 2), (3, 0, 3)]


def test_transcripts(spark):
    rows = [("d", i, i * 5, None, "a" if i % 2 else "b", "w" * 120) for i in range(20)]
    verdict = lambda r: segments.validated(spark.createDataFrame(r, "doc string, at int, start int, end int, speaker string, text string")).first().valid
    change = lambda k, **new: [(d, a, new.get("start", s) if a == k else s, new.get("end", e) if a == k else e, p, new.get("text", t) if a == k else t) for d, a, s, e, p, t in rows]
    assert verdict(rows) and verdict(change(5, start=20)) and not verdict(change(5, start=19)) and not verdict(rows[:19]) and not verdict(change(3, text=" ")) and not verdict(change(3, end=15))
