"""What differed from SQL, or grew faster than its input, on larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import markets
from tidemark.functions.rounding import nearest
from tidemark.operators import decisions, queues, story_store
from tidemark.plans import more

#: Prices whose bids are moved the other way by the decimal text.
PRICES = (1450.0, 2850.0, 5650.0, 5750.0, 10050.0, 10150.0, 10250.0, 10350.0)


def test_rounding_is_that_of_sql(spark):
    values = [1.9 * 1.05, 5.1 * 1.05, 4.3 * 1.05, 2.5 * 1.13, 4.25 * 1.18, -1.9 * 1.05, 0.5, 1.005, None, 2.675]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", nearest(F.col("v"), 2).alias("r"))
    want = duckdb.sql("SELECT k, round(v, 2) FROM (VALUES " + ", ".join(f"({k}, {'NULL' if v is None else repr(v)}::DOUBLE)" for k, v in enumerate(values)) + ") t(k, v) ORDER BY k").fetchall()
    assert [tuple(r) for r in got.orderBy("k").collect()] == want
    assert want[0][1] == 2.0  # 1.99 by the decimal text


def test_contract_gate_at_prices_between_two_cents(spark, tmp_path):
    columns = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_discount double, l_tax double, l_quantity double"
    # Contracts that nothing but the spread can reject.
    lines = [(705 + 7800 * k, 1, 1600, 150, p, 0.05, t, 30.0) for k, (p, t) in enumerate((p, t) for p in PRICES for t in (0.0, 0.05))]
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in more.contract_gate(spark, str(tmp_path)).collect())
    assert any(r[2] == "" for r in got)
    session = duckdb.connect()
    session.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(session.sql(more.SQL["contract_gate"]).fetchall())


@pytest.mark.parametrize("values", [[0.1, 0.1001], [0.35, 0.3501], [0.5649, 0.565], [0.62, 0.6201], [0.8599, 0.86]])
def test_means_between_two_places(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "v double").agg(decisions.mean4(F.col("v"))).first()[0]
    whole = sum(round(v * 10_000) for v in values)
    assert got == duckdb.sql(f"SELECT round({whole} / ({len(values)} * 10000.0::DOUBLE), 4)").fetchall()[0][0]


def test_rolling_counts_and_gaps_meet_no_window_of_rows(spark):
    times = [0, 0, 5, 3599, 3600, 3600, 7199, 7200, 9000, 90_000, 90_001, 176_400, 400_000, None, None]
    rows = [(k, key, None if t is None else t) for k, (key, t) in enumerate((key, t) for key in ("a", "b", None) for t in times if key != "b" or t != 3600)]
    asked = spark.createDataFrame(rows, "id int, key string, s bigint").select("id", "key", "s", F.timestamp_seconds("s").alias("ts"))
    spans = {"near": 3600, "odd": 5000, "far": 86_400}
    counted = queues.gaps(queues.rolling_counts(asked, "key", "ts", spans), "key", "ts", "id")
    got = {r["id"]: (*[r[name] for name in spans], r["gap"]) for r in counted.collect()}
    want = {}
    for i, key, s in rows:
        own = [(t, j) for j, k, t in rows if k == key and t is not None]
        before = [t for t, j in own if s is not None and (t, j) < (s, i)]
        none = sum(k == key and t is None for _, k, t in rows)
        want[i] = (*[none if s is None else sum(s - span <= t <= s for t, _ in own) for span in spans.values()], s - max(before) if before else None)
    assert got == want
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in plan


def test_key_of_a_title_that_repeats_in_its_shown_form(spark):
    """Shown, the title keeps four of its words; the key of what came, as the query's SQL has it, is those four, the key of what is shown two."""
    title = "Adomente Adomente Adomente Adomente Adomente Adomente Adomen"
    rows = [(1, title, "https://a.com/1"), (2, "Adomente Adomente", "https://a.com/2")]
    items = spark.createDataFrame(rows, "item_id bigint, title string, url string").selectExpr(
        "item_id", "title", "'' AS snippet", "'page' AS source", "url", "'p' AS kol_key", "'low' AS impact", "false AS has_market_kw", "'' AS tickers", "timestamp'2026-01-01' AS published_at", "timestamp'2026-01-01' AS seen_at"
    )
    got = {r["event_id"]: r for r in story_store.observed(items, by_shown=False).collect()}
    assert got[1]["title"]["title"] == "Adomente Adomente Adomente Adomente" and got[1]["plain"] == "adomente" * 4
    assert story_store.observed(items).where("event_id = 1").first()["plain"] == "adomente" * 2


def test_an_asset_is_read_once_a_row(spark):
    df = spark.createDataFrame([("US:BRK.B", "yahoo", "ai chips")], "a string, p string, t string")
    for rule in (markets.resolved(F.col("a"), F.col("p")), markets.symbol(F.col("a"), F.col("p")), markets.benchmark(F.col("a"), F.col("t"))):
        assert df.select(rule)._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
