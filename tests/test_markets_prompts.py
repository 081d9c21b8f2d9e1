"""Sessions over both clock changes, symbols with lineage, and requests of bounded length against plain Python."""

import datetime as dt
import json
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.functions import markets
from tidemark.operators import prompts

NY, SH = ZoneInfo("America/New_York"), ZoneInfo("Asia/Shanghai")


def s(*parts, zone=dt.UTC):
    return int(dt.datetime(*parts, tzinfo=zone).timestamp())


SESSIONS = [
    # The last day before each change, and the first after it.
    (s(2026, 3, 6, 14, 30), "US:SPY", "1d", "America/New_York", s(2026, 3, 6, 21), "market_close"), (s(2026, 3, 9, 13, 30), "US:SPY", "1d", "America/New_York", s(2026, 3, 9, 20), "market_close"),
    (s(2026, 10, 30, 13, 30), "INDEX:VIX", "1d", "America/Chicago", s(2026, 10, 30, 20, 15), "market_close"), (s(2026, 11, 2, 14, 30), "INDEX:VIX", "1D ", "America/Chicago", s(2026, 11, 2, 21, 15), "market_close"),
    (s(2026, 7, 1, 1, 30), "cn:600519", "1d", "Asia/Shanghai", s(2026, 7, 1, 7), "market_close"), (s(2026, 7, 1, 18), "INDEX:CSI300", "1d", "Asia/Shanghai", s(2026, 7, 2, 7), "market_close"),
    (s(2026, 3, 6, 0), "FX:USD/CNY", "1d", "Europe/London", s(2026, 3, 6, 22), "market_close"), (s(2026, 3, 9, 0), "FX:USD/CNY", "1d", "Europe/London", s(2026, 3, 9, 21), "market_close"),
    (s(2026, 3, 7, 12), "FX:JPY", "1d", "", None, "market_close"), (s(2026, 3, 6, 23, 30), "FX:JPY", "1d", "Asia/Tokyo", None, "market_close"), (s(2026, 3, 8, 23), "FX:JPY", "1d", "Asia/Tokyo", s(2026, 3, 9, 21), "market_close"),
    (s(2026, 3, 7, 12), "FX:JPY", "1d", "No/Where", s(2026, 3, 7, 12), "provider"), (s(2026, 3, 6, 14), "US:SPY", "1h", "America/New_York", s(2026, 3, 6, 14), "provider"),
    (s(2026, 3, 6, 14), "US:SPY", "1d", "Europe/London", s(2026, 3, 6, 14), "provider"), (s(2026, 3, 6, 14), "CRYPTO:BTC", "1d", "UTC", s(2026, 3, 6, 14), "provider"), (s(2026, 3, 6, 14), None, None, None, s(2026, 3, 6, 14), "provider"),
]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_sessions(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k, *r[:4]) for k, r in enumerate(SESSIONS)], "k int, t bigint, a string, i string, z string")
        got = [tuple(r[0]) for r in df.orderBy("k").select(markets.observed(F.col("t"), F.col("a"), F.col("i"), F.col("z"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [r[4:] for r in SESSIONS]


ASSETS = [
    # (asset, provider, requested, price asset, symbol, proxy for)
    ("us:brk.b", "yahoo", "US:BRK.B", "US:BRK.B", "BRK-B", None), (" THEME:AI ", "Yahoo", "THEME:AI", "US:SOXX", "SOXX", "THEME:AI"), ("THEME:CRYPTO", "yahoo", "THEME:CRYPTO", "CRYPTO:BTC", "BTC-USD", "THEME:CRYPTO"),
    ("CN:600519", "yahoo", "CN:600519", "CN:600519", "600519.SS", None), ("CN:600519", "tencent", "CN:600519", "CN:600519", "sh600519", None), ("CN:000001", "tencent", "CN:000001", "CN:000001", "sz000001", None),
    ("CN:830799", "yahoo", "CN:830799", "CN:830799", "830799.BJ", None), ("CN:113001", "yahoo", "CN:113001", "CN:113001", "113001.SS", None), ("CN:12345", "yahoo", "CN:12345", "CN:12345", None, None), ("US:SPY", "tencent", "US:SPY", "US:SPY", None, None),
    ("FX:USD/CNY", "yahoo", "FX:USD/CNY", "FX:USD/CNY", "CNY=X", None), ("INDEX:XX", "yahoo", "INDEX:XX", "INDEX:XX", None, None), ("a:b:c", "yahoo", "a:b:c", None, None, None), ("US:", "x", "US:", None, None, None), (None, None, None, None, None, None),
]


def test_symbols(spark):
    df = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(ASSETS)], "k int, a string, p string")
    got = [r[0] for r in df.orderBy("k").select(markets.resolved(F.col("a"), F.col("p"))).collect()]
    assert [(r["requested"], r["price_asset"], r["symbol"], r["proxy_for"]) for r in got] == [r[2:] for r in ASSETS]


def test_benchmarks(spark):
    cases = [("THEME:AI", "x", "US:SPY"), ("US:NVDA", "AI chips", "US:SOXX"), ("US:SOXX", "芯片", "US:SPY"), ("US:SPY", "", None), ("CN:600519", None, "INDEX:CSI300"), ("CRYPTO:ETH", "", "CRYPTO:BTC"), ("CRYPTO:BTC", "", None), ("FX:JPY", "", "FX:DXY"), ("BOND:X", "", None), ("x", "ai", None)]
    df = spark.createDataFrame([(k, a, t) for k, (a, t, _) in enumerate(cases)], "k int, a string, t string")
    assert [r[0] for r in df.orderBy("k").select(markets.benchmark(F.col("a"), F.col("t"))).collect()] == [b for *_, b in cases]


def ask(parts):
    return "Sum up:\n" + json.dumps([{"id": p["at"], "text": p["text"]} for p in parts], ensure_ascii=False)


def plain(texts, most, chunk):
    """All chunks first, then each halved from a list of those that wait."""
    chunks, now, size = [], [], 0
    for at, text in texts:
        for start in range(0, len(text), chunk):
            piece = (at, start, text[start : start + chunk])
            if now and size + len(piece[2]) > chunk:
                chunks, now, size = [*chunks, now], [], 0
            now, size = [*now, piece], size + len(piece[2])
    waiting, out = [*chunks, *([now] if now else [])][::-1], []
    while waiting:
        c = waiting.pop()
        if len(json.dumps([{"role": "user", "content": ask([{"at": a, "text": t} for a, _, t in c])}], ensure_ascii=False)) <= most:
            out.append(c)
        elif len(c) > 1:
            waiting += [c[len(c) // 2 :], c[: len(c) // 2]]
        else:
            a, start, t = c[0]
            m = len(t) // 2
            waiting += [[(a, start + m, t[m:])], [(a, start, t[:m])]]
    return out


@pytest.mark.parametrize(("most", "chunk"), [(300, 120), (160, 90), (2000, 500)])
def test_requests(spark, most, chunk):
    rng = random.Random(most)
    docs = {d: [(k, "".join(rng.choices('ab "\\\n中', k=rng.choice([0, 1, 7, 40, 300])))) for k in range(rng.randint(1, 25))] for d in range(12)}
    rows = [(d, k, t) for d, texts in docs.items() for k, t in texts] + [(99, 0, None), (None, 1, "last"), (None, 0, "first ")]
    df = spark.createDataFrame(rows, "doc int, at int, text string").repartition(5)
    got = prompts.bounded(df, ask, most, chunk).collect()
    for d, texts in docs.items():
        mine = {}
        for r in sorted((r for r in got if r["doc"] == d), key=lambda r: (r["request"], r["place"])):
            mine.setdefault(r["request"], []).append((r["at"], r["start"], r["text"]))
        assert list(mine.values()) == plain(texts, most, chunk)
        assert "".join(t for c in mine.values() for *_, t in c) == "".join(t for _, t in texts)
        assert all(prompts.measured(ask([{"at": a, "text": t} for a, _, t in c])) <= most for c in mine.values())
    assert [r["text"] for r in sorted((r for r in got if r["doc"] is None), key=lambda r: r["place"])] == ["first ", "last"]
    with pytest.raises(Exception, match="exceeds the limit"):
        prompts.bounded(df, ask, 20, chunk).collect()


def test_packing(spark):
    rng = random.Random(2)
    docs = {d: ["x" * rng.randint(1, 60) + '"' * rng.randint(0, 9) for _ in range(rng.randint(1, 30))] for d in range(9)}
    df = spark.createDataFrame([(d, k, t) for d, texts in docs.items() for k, t in enumerate(texts)], "doc int, at int, text string").repartition(4)
    join = lambda texts: "Merge: " + "\n".join(texts)
    got = {(r["doc"], r["at"]): r["request"] for r in prompts.packed(df, join, 200).collect()}
    for d, texts in docs.items():
        groups, now = 0, []
        for k, t in enumerate(texts):
            if now and prompts.measured(join([*now, t])) > 200:
                groups, now = groups + 1, []
            now.append(t)
            assert got[d, k] == groups
    with pytest.raises(Exception, match="exceeds the limit"):
        prompts.packed(df, join, 30).collect()
