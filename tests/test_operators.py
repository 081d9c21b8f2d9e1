"""Operators that SQL can't express, and edge cases, against plain Python."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, times, titles, urls
from tidemark.operators import alerts, decisions, performance, stories, store
from tidemark.operators.components import components
from tidemark.sources import payloads
from tidemark.streaming import feeds


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Ex.com/A/?utm_source=x&b=2&a=1#top", "https://ex.com/A?b=2&a=1"), ("http://ex.com", "http://ex.com/"), ("http://ex.com/?SRC=1", "http://ex.com/"), ("not a url", "not a url"), (" http://e.com/x// ", "http://e.com/x"),
        ("http://e.com/p?", "http://e.com/p"), (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, url, urls.canonical_url) == want


@pytest.mark.parametrize(("title", "want"), [("Hello, World!", "helloworld"), ("abcdef abcdef", "abcdef"), ("ABCDEFGH abcdefgh", "abcdefgh"), ("short short", "shortshort"), ("", ""), (None, ""), ("涨价 12%", "涨价12")])
def test_normal_title(spark, title, want):
    assert one(spark, title, titles.normal_title) == want


@pytest.mark.parametrize(("text", "want"), [("up 25bp, then 3.5% and 25 basis points", ["25bp", "3.5pct"]), ("none", []), ("1bps 2 percent", ["1bp"])])
def test_amounts(spark, text, want):
    assert one(spark, text, titles.amounts) == want


@pytest.mark.parametrize(("text", "want"), [("upside benefit", "bullish"), ("not positive", "unknown"), ("never a positive but risk", "bearish"), ("buy and sell", "unknown"), ("buyer", "unknown"), ("no big upside", "unknown")])
def test_stance(spark, text, want):
    assert one(spark, text, rules.stance) == want


@pytest.mark.parametrize(("label", "want"), [("5m", 6 * 60), ("2h", 3 * 3600), ("yesterday", None), ("3 days ago", None), ("soon", None)])
def test_relative_times_take_the_older_edge(spark, label, want):
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    got = one(spark, label, lambda c: F.unix_seconds(now) - F.unix_seconds(times.relative(c, now)))
    assert got == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("Wed, 03 Jan 2024 10:00:00 GMT", "2024-01-03 10:00:00"), ("2024-01-03T10:00:00+08:00", "2024-01-03 02:00:00"), ("2024-01-03T10:00:00", None), ("03 Jan 2024 10:00:00 -0500", "2024-01-03 15:00:00"), ("soon", None), (None, None)],
)
def test_feed_time_needs_an_offset(spark, text, want):
    assert one(spark, text, lambda c: F.date_format(payloads.feed_time(c), "yyyy-MM-dd HH:mm:ss")) == want


def test_feed_items_refuse_unsafe_xml_and_repeat_no_url(spark):
    item = "<item><title>{}</title><link>{}</link></item>"
    good = "<rss><channel>" + item.format("a", "http://x/1") + item.format("b", "http://x/1") + item.format("c", "http://x/2") + "</channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link href="http://y/1"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>'
    rows = [("good", good), ("atom", atom), ("dtd", "<!DOCTYPE x>" + good), ("broken", "<rss><item>"), ("none", None), ("empty", "")]
    got = payloads.feed_items(spark.createDataFrame(rows, "source string, body string")).collect()
    assert sorted((r.source, r.title, r.url) for r in got) == [("atom", "t", "http://y/1"), ("good", "a", "http://x/1"), ("good", "c", "http://x/2")]


def test_a_day_given_twice_is_an_error(spark):
    lines = spark.createDataFrame([("s", "2024-01-02,1"), ("s", "01/02/2024,2")], "series string, line string")
    with pytest.raises(Exception, match="twice"):
        payloads.series_csv(lines).collect()


def series(spark, values, name="s"):
    start = dt.date(2020, 1, 1)
    return spark.createDataFrame([(name, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "series string, day date, value double")


def test_first_of_equal_drawdowns_and_its_first_peak(spark):
    r = performance.max_drawdown(series(spark, [10, 10, 5, 10, 5, 8])).first()
    assert (r.drawdown, r.peak_day, r.trough_day) == (-0.5, dt.date(2020, 1, 1), dt.date(2020, 1, 3))


def test_volatility_of_few_points_is_zero(spark):
    assert [performance.volatility(series(spark, v)).first().volatility for v in ([1], [1, 2])] == [0.0, 0.0]
    r = performance.volatility(series(spark, [100, 110, 99])).first().volatility
    assert r == pytest.approx(math.sqrt(252) * math.sqrt(((0.1 - 0) ** 2 + (-0.1 - 0) ** 2) / 1))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    root = list(range(200))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    touched = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: find(i) for i in touched}


def test_prefix_twins_of_branching_titles(spark):
    base = "abcdefghijklmnop"
    rows = [(1, base), (2, base + "q"), (3, base + "z"), (4, base + "zz"), (5, "abcdefghijkl"), (6, None)]
    got = {r.item_id: r.class_title for r in stories.fold_prefixes(spark.createDataFrame(rows, "item_id long, title string")).collect()}
    assert got == {1: base + "zz", 2: base + "q", 3: base + "zz", 4: base + "zz", 5: "abcdefghijkl", 6: ""}


def brute_summary(cards, k):
    topic_quota, asset_quota = max(2, math.ceil(k / 4)), max(1, math.ceil(k / 6))
    chosen, topics, assets = list(range(min(2, k, len(cards)))), Counter(), Counter()
    for i in chosen:
        topics[cards[i][0]] += 1
        assets[cards[i][1]] += 1
    for i in range(len(chosen), len(cards)):
        if len(chosen) < k and topics[cards[i][0]] < topic_quota and assets[cards[i][1]] < asset_quota:
            chosen.append(i)
            topics[cards[i][0]] += 1
            assets[cards[i][1]] += 1
    for i in range(len(cards)):
        if len(chosen) < k and i not in chosen:
            chosen.append(i)
    return sorted(chosen)


@pytest.mark.parametrize("k", [1, 2, 5, 12, 50])
def test_diversified_selection(spark, k):
    rng = random.Random(k)
    rows = [(f"t{rng.randrange(4)}", f"a{i % 9}", "verify", True, True, 1 - i / 100) for i in range(30)]
    cards = spark.createDataFrame(rows, "topic string, asset string, stage string, abstain boolean, veto boolean, score double")
    got = [(r.topic, r.asset, r.score) for r in decisions.select_summary(cards, k).collect()]
    assert got == [(rows[i][0], rows[i][1], rows[i][5]) for i in brute_summary(rows, k)]


@pytest.mark.parametrize("k", [3, 12, 50])
def test_selection_from_many(spark, k):
    """A hot pair, a hot topic and a hot asset before all others."""
    rng = random.Random(k)
    names = [("t0", "a0")] * 400 + [("t0", f"a{i}") for i in range(300)] + [(f"t{i}", "a0") for i in range(300)] + [(f"t{rng.randrange(9)}", f"a{rng.randrange(40)}") for _ in range(500)]
    rows = [(t, a, "verify", True, True, 1 - i / 10_000) for i, (t, a) in enumerate(names)]
    cards = spark.createDataFrame(rows, "topic string, asset string, stage string, abstain boolean, veto boolean, score double").repartition(5)
    got = [(r.topic, r.asset, r.score) for r in decisions.select_summary(cards, k).collect()]
    assert got == [(rows[i][0], rows[i][1], rows[i][5]) for i in brute_summary(rows, k)]
    assert decisions.select_summary(cards.limit(0), k).count() == 0


def test_alert_needs_two_days_up_and_two_days_down(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    calm, hot, worst = (True, False, False, False, 0, 0, True), (True, True, True, False, 1, 0, True), (True, True, True, True, 2, 2, True)
    steps = [calm, hot, hot, calm, calm, hot, hot, worst, worst, calm, calm, (False, *calm[1:]), hot]
    want = ["observe", "prepare_reduce", "reduce_candidate", "reduce_candidate", "observe", "prepare_reduce", "reduce_candidate", "reduce_candidate", "exit_candidate", "exit_candidate", "observe", "observe", "prepare_reduce"]
    rows = [(m, day(i), *s) for m in ("US", "CN") for i, s in enumerate(steps)]
    schema = "market string, day date, valid boolean, watch boolean, confirmed boolean, severe boolean, strong int, critical int, fx boolean"
    got = alerts.replay(spark.createDataFrame(rows, schema).repartition(5)).collect()
    for m in ("US", "CN"):
        assert [r.action for r in sorted(got, key=lambda r: r.day) if r.market == m] == want
    assert {r.level for r in got if r.day == day(11)} == {"insufficient"} and {r.pending for r in got if r.day == day(3)} == {True}


ALERT_DAYS = "market string, day date, valid boolean, watch boolean, confirmed boolean, severe boolean, strong int, critical int, fx boolean"


def alert_days(seed, markets=("CN", "US"), n=60, again=0.15):
    rng = random.Random(seed)
    out = []
    for m in markets:
        for i in range(n):
            severe = rng.random() < 0.4
            confirmed = severe or rng.random() < 0.4
            out.append((m, dt.date(2024, 1, 1) + dt.timedelta(days=i - (rng.random() < again)), rng.random() < 0.95, confirmed or rng.random() < 0.3, confirmed, severe, rng.randint(0, 2), rng.randint(0, 3), rng.random() < 0.7))
    return out


def brute_alerts(rows):
    """The rules read one evaluation after the other, each from the record of the one before."""
    rank = {a: k for k, a in enumerate(alerts.ACTIONS)}
    out, before = [], {}
    for market, day, valid, watch, confirmed, severe, strong, critical, fx in sorted(rows):
        p = before.get(market, {"action": "observe", "reduce": [], "exit": [], "recovery": []})
        add = lambda name: [*p[name], *([day] if day not in p[name] else [])][-3:]  # noqa: B023
        raw_reduce, raw_exit = confirmed and strong > 0, severe and critical >= 2 and fx
        reduce, exit_ = add("reduce") if raw_reduce or raw_exit else [], add("exit") if raw_exit else []
        action = "prepare_reduce" if raw_reduce or raw_exit or watch or strong else "observe"
        action = "reduce_candidate" if len(reduce) >= 2 else action
        if len(exit_) >= 2 and p["action"] in ("reduce_candidate", "exit_candidate"):
            action = "exit_candidate"
        recovery, pending = [], False
        active = (p["action"] == "reduce_candidate" and (raw_reduce or raw_exit)) or (p["action"] == "exit_candidate" and raw_exit)
        if rank[p["action"]] > rank[action]:
            if active:
                action = p["action"]
            else:
                recovery = add("recovery")
                action, pending = (p["action"], True) if len(recovery) < 2 else (action, False)
        if not valid:
            action, reduce, exit_, recovery, pending = "observe", [], [], [], False
        before[market] = {"action": action, "reduce": reduce, "exit": exit_, "recovery": recovery}
        out.append((market, day, action, "insufficient" if not valid else ["low", "medium", "high", "critical"][rank[action]], pending))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_alerts_against_plain(spark, seed):
    rows = alert_days(seed)
    got = [tuple(r) for r in alerts.replay(spark.createDataFrame(rows, ALERT_DAYS).repartition(4)).collect()]
    assert sorted(got) == sorted(brute_alerts(rows))


def test_alerts_as_a_stream(spark, tmp_path):
    """Three batches, days in order, give what the replay of all gives; a kept state of other rules is none."""
    rows = sorted(alert_days(9, n=30, again=0), key=lambda r: (r[1], r[0]))
    landing, out, point = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    provider, key = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        for part in (rows[:21], rows[21:40], rows[40:]):
            days = spark.createDataFrame(part, ALERT_DAYS)
            days.coalesce(1).write.mode("append").parquet(landing)
            stream = alerts.follow(spark.readStream.schema(ALERT_DAYS).parquet(landing)).writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/part={k}"))
            stream.outputMode("update").option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = [tuple(r)[:5] for r in spark.read.parquet(out).select("market", "day", "action", "level", "pending").collect()]
    want = [tuple(r) for r in alerts.replay(spark.createDataFrame(rows, ALERT_DAYS)).collect()]
    assert sorted(got) == sorted(want)


def test_snapshots_may_not_go_back(spark):
    s = "day date, generated_at int, payload string"
    d = dt.date(2024, 1, 1)
    old = spark.createDataFrame([(d, 5, "a")], s)
    for new, refused in (((d, 4, "b"), True), ((d, 5, "b"), True), ((d, 5, "a"), False), ((d, 6, "b"), False), ((dt.date(2024, 1, 2), 1, "b"), False)):
        merged, bad = store.merge_snapshots(old, spark.createDataFrame([new], s))
        assert bad.count() == refused and (tuple(merged.where(F.col("day") == new[0]).first()) == new) is not refused


def test_stream_sets_undated_aside_and_merges_across_batches(spark, tmp_path):
    t = lambda minute: dt.datetime(2024, 1, 1, 0, minute)
    first = [(1, "k", "s", "u", t(1), t(2)), (1, "k", "s", "u", t(0), t(3)), (2, "k", "s", "u", None, t(4)), (3, "k", "s", "u", t(50), t(5))]
    second = [(1, "k", "s", "u", t(9), t(10)), (1, "k", "s", "u", t(9), t(10))]
    for rows in (first, second):
        spark.createDataFrame(rows, feeds.SCHEMA).write.mode("append").parquet(f"{tmp_path}/landing")
        feeds.run(spark, f"{tmp_path}/landing", f"{tmp_path}/out", f"{tmp_path}/aside", name=f"stream-{tmp_path.name}").awaitTermination()
    got = feeds.merged(spark, f"{tmp_path}/out").collect()
    assert [(r.event_id, r.observations, r.first_seen, r.last_seen) for r in got] == [(1, 3, t(2), t(10))]
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/aside").collect()) == [2, 3]


def test_late_rows_still_count_within_the_watermark(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), "x") for h, m in ((0, 5), (0, 29), (0, 31), (9, 0), (1, 0))]
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/in")
    q = feeds.slot_counts(stream).writeStream.format("memory").queryName("slots").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.slot.hour, r.slot.minute): r.n for r in spark.table("slots").collect() if r.slot.hour < 2} == {(0, 0): 2, (0, 30): 1, (1, 0): 1}
