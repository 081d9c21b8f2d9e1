"""States of readings and reads of stored rows on literal cases."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from tidemark.functions import states
from tidemark.operators import reads, stories
from tidemark.plans import reads as plan


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def double(x):
    return F.lit(x).cast("double")


def test_states(spark):
    got = [value(spark, states.stress_status(double(x))) for x in (None, -1, 0, 0.1, 2, 2.1, 5, 5.1)]
    assert got == ["unknown", "low", "low", "normal", "normal", "elevated", "elevated", "critical"]
    curve = lambda two, ten, thirty: tuple(value(spark, states.curve(double(two), double(ten), double(thirty))))
    assert curve(4.5, 4.0, 4.25) == ("deep_inverted", "recession_warning", -0.5, 0.25)
    assert curve(4.5, 4.25, None) == ("inverted", "recession_watch", -0.25, None)
    assert curve(4.0, 4.0, 4.0)[:2] == ("flat", "uncertainty")
    assert curve(4.0, 5.0, 5.0)[:2] == ("normal", "normal")
    assert curve(4.0, 5.5, 5.0)[:2] == ("steep", "growth_expectation")
    assert curve(0.0, 5.5, None) == ("unknown", None, None, None)
    term = lambda spot, nxt: tuple(value(spark, states.term_structure(double(spot), double(nxt))))
    assert [term(20, x)[0] for x in (22.5, 22, 20, 18.5, 18, None)] == ["contango_steep", "contango", "backwardation_mild", "backwardation_mild", "backwardation_steep", "unknown"]
    assert [value(spark, states.coverage_ratio(F.lit(a).cast("int"), F.lit(t).cast("int"))) for a, t in ((1, 3), (5, 3), (-1, 3), (1, 0), (None, 3), (1, None))] == [0.3333, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_asset_tags(spark):
    items = F.array(*[F.lit(x) for x in ("NVDA", " 区域银行ETF (KRE) ", "几乎所有资产", "NVDA", "BRK-B", "gold", "（SPY）", "")])
    got = value(spark, states.asset_tags(items))
    assert got["tickers"] == ["NVDA", "KRE", "BRK-B", "SPY"]
    assert got["sectors"] == ["区域银行ETF", "几乎所有资产", "gold"]
    assert tuple(value(spark, states.asset_tags(F.lit(None).cast("array<string>")))) == ([], [])


def test_content_eligible(spark):
    ask = lambda source, url, snippet, title: value(spark, states.content_eligible(*[F.lit(x).cast("string") for x in (source, url, snippet, title)]))
    assert ask("wire", "https://a.com", "", "")
    assert not ask("Truth Social", None, "RT @a https://b.com/c", "Tariffs are coming")
    assert ask("Truth Social", None, "", "Tariffs are coming")
    assert not ask(None, "https://TruthSocial.com/@a/1", None, None)


def test_prose_that_begins_like_an_attribution(spark, tmp_path):
    """Short documents as larger tables have them: From, By and links are a document's own words, a post's marks aren't."""
    texts = ["From.", "By of.", "via @b", "RT", "www.example.com", "$A", "ab", "中文", "", None, "a b c", "By a"]
    rows = [(i, texts[i % len(texts)]) for i in range(420 * len(texts))]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["eligible"] for r in plan.content_eligible(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(duck.sql(plan.SQL["content_eligible"]).fetchall())
    ask = lambda text, prose: value(spark, states.content_eligible(F.lit("Truth Social"), F.lit(None).cast("string"), F.lit(text), F.lit(""), (F.lit(prose), F.lit(prose))))
    assert ask("From.", True) and not ask("From.", False)


def test_stale_alert_keeps_its_other_gates(spark):
    rows = [(1, "2024-01-01 10:30:00"), (2, "2024-01-01 10:29:59"), (3, "2024-01-01 12:05:01"), (4, None)]
    gate = lambda key: F.struct(F.lit(key).alias("key"), F.lit("l").alias("label"), F.lit("met").alias("status"), F.lit("d").alias("detail"))
    alert = F.struct(
        F.col("at").cast("timestamp").alias("generated_at"), F.lit("reduce").alias("action"), F.lit("r").alias("action_label"), F.lit("high").alias("risk_level"), F.lit(False).alias("abstain"), F.lit("ok").alias("data_status"),
        F.lit("s").alias("summary"), F.array(F.lit("vix")).alias("missing_sources"), F.array(gate("trend")).alias("gates"),
    )
    df = spark.createDataFrame(rows, "id int, at string").select("id", states.expired(alert, F.lit("2024-01-01 12:00:00").cast("timestamp")).alias("a"))
    got = {r["id"]: r["a"] for r in df.collect()}
    assert got[1]["action"] == "reduce" and got[1]["missing_sources"] == ["vix"] and got[4] is None
    assert got[2]["action"] == "observe" and got[2]["abstain"] and got[2]["missing_sources"] == ["vix", states.EXPIRED]
    assert [(g["key"], g["status"]) for g in got[2]["gates"]] == [("data_freshness", "unavailable"), ("trend", "met")]
    assert got[3]["summary"].startswith(states.AHEAD)


def test_merged_content(spark):
    schema = "id int, title string, snippet string, tickers array<string>, substantive boolean"
    old = [(1, "a long headline of the day", "x", ["A"], True), (2, "https://x", "", ["B"], False), (3, "one story about chips", "long text", ["C"], True), (4, "only stored", "s", ["D"], True)]
    new = [(1, "a long headline of the day, told", "", ["Z"], True), (2, "words", "more", ["Y"], True), (3, "another story", "t", ["X"], True), (5, "only new", "n", ["E"], True)]
    got = {r["id"]: tuple(r)[1:] for r in reads.merged_content(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["id"]).collect()}
    assert got == {
        1: ("a long headline of the day, told", "x", ["A", "Z"]), 2: ("words", "more", ["Y"]), 3: ("another story", "t", ["X"]), 4: ("only stored", "s", ["D"]), 5: ("only new", "n", ["E"]),
    }


def test_empty_and_null_rows(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    none = spark.createDataFrame([], "owner int, revision int, digest string, review_due timestamp")
    asked = spark.createDataFrame([(1, "a", 0), (2, "a", 3)], "owner int, digest string, expected int")
    got = {r["owner"]: (r["verdict"], r["revision"], r["review_due"]) for r in reads.policy_verdicts(none, asked, now).collect()}
    assert got == {1: ("saved", 1, datetime(2024, 2, 1)), 2: ("conflict", 0, None)}
    positions = spark.createDataFrame([(1, "A", 5.0), (1, "B", 2.0), (2, "A", None)], "account int, symbol string, market_value double")
    targets = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A")], "account int, target string")
    assert {r[0]: r[1] for r in reads.position_values(positions, targets).collect()} == {1: 5.0, 2: None, 3: 0.0}
    events = spark.createDataFrame([(1, "k"), (2, " "), (3, None)], "event_id int, dedup_key string")
    assert sorted(r[0] for r in reads.source_ids(events).collect()) == ["1", "2", "3", "k"]


def test_moved_sightings_keep_the_best_publication(spark):
    schema = "event_id int, kol_key string, source string, source_url string, observations int, first_seen string, last_seen string, time_status string, published_at string"
    rows = [
        (1, "a", "s", "u", 2, "2024-01-03", "2024-01-04", "future", "2024-02-01"), (2, "a", "s", "u", 3, "2024-01-01", "2024-01-02", "verified", "2024-01-01"),
        (1, "b", "s", "u", 1, "2024-01-05", "2024-01-05", "verified", "2024-01-05"), (2, "b", "s", "u", 1, "2024-01-01", "2024-01-01", "verified", "2024-01-01"), (2, "c", "s", "u", 1, "2024-01-01", "2024-01-01", "unknown", None),
    ]
    df = spark.createDataFrame(rows, schema)
    for c in ("first_seen", "last_seen", "published_at"):
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    moves = spark.createDataFrame([(2, 1)], "event_id int, keep_id int")
    got = {r["kol_key"]: (r["event_id"], r["observations"], r["first_seen"].day, r["last_seen"].day, r["time_status"], r["published_at"] and r["published_at"].day) for r in stories.moved_sightings(df, moves).collect()}
    # A verified time beats one ahead; of two verified ones that of the event that stays is kept.
    assert got == {"a": (1, 5, 1, 4, "verified", 1), "b": (1, 2, 1, 5, "verified", 5), "c": (1, 1, 1, 1, "unknown", None)}


def test_only_the_holder_of_a_claim_ends_it(spark):
    claims = spark.createDataFrame([(1, "t", "processing", "", None), (2, "t", "processing", "", None), (3, "t", "ready", "", None), (4, "t", "processing", "", None)], "task int, token string, status string, error string, next_attempt timestamp")
    failures = spark.createDataFrame([(1, "t", "HTTP 429", 5), (2, "other", "x", 5), (3, "t", "x", 5), (4, "t", "", None)], "task int, token string, code string, retry_seconds int")
    got = {r["task"]: tuple(r)[1:] for r in reads.failed_claims(claims, failures, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {1: ("", "retry", "http429", datetime(2024, 1, 1, 0, 1)), 2: ("t", "processing", "", None), 3: ("t", "ready", "", None), 4: ("", "failed", "unknown", None)}
