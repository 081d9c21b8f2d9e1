"""Queries on price bars and index performance, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import performance as perf
from ..operators import prices
from ..sources.tables import table
from .common import dated, shown


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "ts", "event_type", "value").select(F.col("event_type").alias("asset"), "ts", F.col("value").alias("close"), "event_id")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return prices.daily_bars(_bars(spark, d), "event_id")


def _points(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderdate", "o_orderpriority", "o_totalprice")
    return orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("value"))


def daily_bars(spark, d):
    return shown(_daily(spark, d).select("asset", "day", "close"))


def event_reaction(spark, d):
    bars = _daily(spark, d)
    errors = table(spark, d, "events", "event_id", "ts", "user_id", "event_type").where("event_type = 'error'")
    events = errors.select("event_id", F.lit("purchase").alias("asset"), F.col("ts").alias("event_ts"))
    return shown(prices.event_reactions(events, bars.where("asset = 'purchase'"), bars.where("asset = 'view'")))


def _trend_input(spark, d):
    return _points(spark, d).select(F.col("series").alias("asset"), "day", F.col("value").alias("close"))


def trend_summary(spark, d):
    return shown(prices.trend_summary(_trend_input(spark, d)), 4)


def trend_state(spark, d):
    return prices.trend_state(prices.trend_summary(_trend_input(spark, d))).transform(shown).select("asset", "day", "watch", "confirmed", "severe")


def simple_returns(spark, d):
    return shown(perf.returns(_points(spark, d)).select("series", "day", "ret"), 4)


def volatility(spark, d):
    return shown(perf.volatility(_points(spark, d)), 4)


def max_drawdown(spark, d):
    return shown(perf.max_drawdown(_points(spark, d)))


def month_end(spark, d):
    return shown(perf.month_ends(_points(spark, d)), 2)


def cagr(spark, d):
    return shown(perf.cagr(_points(spark, d)))


def performance_metrics(spark, d):
    return shown(perf.metrics(_points(spark, d)), 4)


def period_return(spark, d):
    return shown(perf.period_return(_points(spark, d), "1995-01-01", "1996-12-31").select("series", "first_day", "last_day", "period_return"))


def trailing_cagr(spark, d):
    return shown(perf.trailing_growth(_points(spark, d)))


def monthly_beta(spark, d):
    return shown(perf.beta(_points(spark, d), "1-URGENT"))


def common_range(spark, d):
    return shown(perf.common_range(_points(spark, d)).groupBy("series").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n")))


def performance_report(spark, d):
    return shown(perf.comparison(_points(spark, d), "1-URGENT"), 4)


_P = "p AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)"
_D = """bars AS (SELECT event_type AS asset, CAST(ts AS DATE) AS day, max(ts) AS ts, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2)"""
_R = "r AS (SELECT series, day, value, value / lag(value) OVER (PARTITION BY series ORDER BY day) - 1 AS ret FROM p)"
_DD = """dd AS (SELECT series, day, value / max(value) OVER w - 1 AS drawdown, arg_max(day, (value, -date_diff('day', DATE '1970-01-01', day))) OVER w AS peak_day
  FROM p WINDOW w AS (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING)),
md AS (SELECT series, min(drawdown) AS drawdown, arg_min(peak_day, (drawdown, day)) AS peak_day, arg_min(day, (drawdown, day)) AS trough_day FROM dd GROUP BY series)"""
_ME = "me AS (SELECT series, CAST(date_trunc('month', day) AS DATE) AS month, max(day) AS day, arg_max(value, day) AS value FROM p GROUP BY 1, 2)"
_MR = "mr AS (SELECT series, month, ret FROM (SELECT series, month, value / lag(value) OVER (PARTITION BY series ORDER BY month) - 1 AS ret FROM me) WHERE ret IS NOT NULL)"
_C = """c AS (SELECT series, count(*) AS observations, pow(arg_max(value, day) / arg_min(value, day), 365.2425::DOUBLE / date_diff('day', min(day), max(day))) - 1 AS cagr FROM p GROUP BY series),
v AS (SELECT series, stddev_samp(ret) * sqrt(252) AS volatility FROM r GROUP BY series)"""
_M = """m AS (SELECT series, stddev_samp(ret) * sqrt(12) AS monthly_volatility, count(*) FILTER (ret > 0) / count(*) AS positive_months, min(ret) AS worst_month_return, arg_min(month, (ret, month)) AS worst_month FROM mr GROUP BY series)"""
_B = """b AS (SELECT x.series, count(*) AS months, covar_samp(x.ret, y.ret) / var_samp(y.ret) AS beta, corr(x.ret, y.ret) AS correlation
  FROM mr x JOIN mr y ON x.month = y.month AND y.series = '1-URGENT' WHERE x.series <> '1-URGENT' GROUP BY x.series HAVING count(*) >= 3)"""
_RANGE = "rng AS (SELECT max(a) AS from_day, min(b) AS to_day FROM (SELECT min(day) AS a, max(day) AS b FROM p0 GROUP BY series)), p AS (SELECT p0.* FROM p0, rng WHERE day BETWEEN from_day AND to_day)"
_T = """t AS (SELECT series AS asset, day, value AS close, row_number() OVER o AS n, avg(value) OVER s AS sma_short, avg(value) OVER l AS sma_long, avg(value) OVER e AS earlier,
  value / lag(value, 5) OVER o - 1 AS return_5, value / max(value) OVER l - 1 AS drawdown FROM p
  WINDOW o AS (PARTITION BY series ORDER BY day), s AS (PARTITION BY series ORDER BY day ROWS 19 PRECEDING), l AS (PARTITION BY series ORDER BY day ROWS 59 PRECEDING),
         e AS (PARTITION BY series ORDER BY day ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING))"""

QUERIES = {
    f.__name__: f
    for f in (daily_bars, event_reaction, trend_summary, trend_state, simple_returns, volatility, max_drawdown, month_end, cagr, performance_metrics, period_return, trailing_cagr, monthly_beta, common_range, performance_report)
}
SQL = {
    "daily_bars": f"WITH {_D} SELECT asset, day, close FROM bars",
    "event_reaction": f"""
WITH {_D}, a AS (SELECT * FROM bars WHERE asset = 'purchase'), b AS (SELECT * FROM bars WHERE asset = 'view'),
days AS (SELECT a.day, least(a.ts, b.ts) AS low, greatest(a.ts, b.ts) AS high, a.close AS c, b.close AS bc, row_number() OVER (ORDER BY a.day) AS n FROM a JOIN b ON a.day = b.day),
e AS (SELECT event_id, ts, (SELECT max(n) FROM days WHERE high < ts) AS base_n, (SELECT coalesce(max(n), 0) FROM days WHERE low < ts) AS first_n FROM events WHERE event_type = 'error')
SELECT e.event_id, 'purchase' AS asset, CAST(k AS INTEGER) AS "window", d0.day AS baseline_day, d1.day AS end_day, round(d1.c / d0.c - 1, 6) AS asset_return, round(d1.bc / d0.bc - 1, 6) AS benchmark_return,
  round(d1.c / d0.c - 1 - (d1.bc / d0.bc - 1), 6) AS abnormal_return, CASE WHEN d1.day IS NULL THEN 'pending' ELSE 'complete' END AS status
FROM e CROSS JOIN (VALUES (1), (3), (5)) w(k) JOIN days d0 ON d0.n = e.base_n LEFT JOIN days d1 ON d1.n = e.first_n + k""",
    "trend_summary": f"WITH {_P}, {_T} SELECT asset, day, round(close, 4) AS close, round(sma_short, 4) AS sma_short, round(sma_long, 4) AS sma_long, round(sma_short - earlier, 4) AS slope, round(return_5, 4) AS return_5, round(drawdown, 4) AS drawdown FROM t WHERE n >= 60",
    "trend_state": f"WITH {_P}, {_T} SELECT asset, day, close < sma_short OR sma_short - earlier < 0 AS watch, close < sma_short AND sma_short - earlier < 0 AS confirmed, close < sma_long AND sma_short < sma_long AND drawdown <= -0.10 AS severe FROM t WHERE n >= 60",
    "simple_returns": f"WITH {_P}, {_R} SELECT series, day, round(ret, 4) AS ret FROM r",
    "volatility": f"WITH {_P}, {_R} SELECT series, round(stddev_samp(ret) * sqrt(252), 4) AS volatility FROM r GROUP BY series",
    "max_drawdown": f"WITH {_P}, {_DD} SELECT series, round(drawdown, 6) AS drawdown, peak_day, trough_day FROM md",
    "month_end": f"WITH {_P}, {_ME} SELECT series, month, day, round(value, 2) AS value FROM me",
    "cagr": f"WITH {_P}, {_R}, {_C} SELECT series, round(cagr, 6) AS cagr, observations FROM c",
    "performance_metrics": f"WITH {_P}, {_R}, {_DD}, {_ME}, {_MR}, {_C}, {_M} SELECT series, round(cagr, 4) AS cagr, observations, round(volatility, 4) AS volatility, round(drawdown, 4) AS drawdown, peak_day, trough_day, round(monthly_volatility, 4) AS monthly_volatility, round(positive_months, 4) AS positive_months, round(worst_month_return, 4) AS worst_month_return, worst_month FROM c JOIN v USING (series) JOIN md USING (series) LEFT JOIN m USING (series)",
    "period_return": f"WITH {_P} SELECT series, min(day) AS first_day, max(day) AS last_day, round(arg_max(value, day) / arg_min(value, day) - 1, 6) AS period_return FROM p WHERE day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY series HAVING min(day) < max(day)",
    "trailing_cagr": f"""WITH {_P}, l AS (SELECT series, max(day) AS end_day, arg_max(value, day) AS end_value FROM p GROUP BY series),
a AS (SELECT l.*, CAST(y AS INTEGER) AS years, CAST(end_day - to_months(CAST(12 * y AS INTEGER)) AS DATE) AS target FROM l, (VALUES (1), (3), (5), (10)) v(y)),
s AS (SELECT a.series, years, end_day, end_value, min(day) AS start_day, arg_min(value, day) AS start_value FROM a JOIN p ON p.series = a.series AND p.day >= a.target AND p.day < a.end_day GROUP BY ALL)
SELECT series, years, start_day, end_day, round(pow(end_value / start_value, 365.2425::DOUBLE / date_diff('day', start_day, end_day)) - 1, 6) AS cagr FROM s""",
    "monthly_beta": f"WITH {_P}, {_ME}, {_MR}, {_B} SELECT series, months, round(beta, 6) AS beta, round(correlation, 6) AS correlation FROM b",
    "common_range": f"WITH {_P.replace('p AS', 'p0 AS', 1)}, {_RANGE} SELECT series, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM p GROUP BY series",
    "performance_report": f"WITH {_P.replace('p AS', 'p0 AS', 1)}, {_RANGE}, {_R}, {_DD}, {_ME}, {_MR}, {_C}, {_M}, {_B} SELECT series, round(cagr, 4) AS cagr, observations, round(volatility, 4) AS volatility, round(drawdown, 4) AS drawdown, peak_day, trough_day, round(monthly_volatility, 4) AS monthly_volatility, round(positive_months, 4) AS positive_months, round(worst_month_return, 4) AS worst_month_return, worst_month, months, round(beta, 4) AS beta, round(correlation, 4) AS correlation FROM c JOIN v USING (series) JOIN md USING (series) LEFT JOIN m USING (series) LEFT JOIN b USING (series)",
}

_DATES = {
    "daily_bars": ["day"], "event_reaction": ["baseline_day", "end_day"], "trend_summary": ["day"], "trend_state": ["day"], "simple_returns": ["day"], "max_drawdown": ["peak_day", "trough_day"],
    "month_end": ["month", "day"], "performance_metrics": ["peak_day", "trough_day", "worst_month"], "period_return": ["first_day", "last_day"], "trailing_cagr": ["start_day", "end_day"],
    "common_range": ["first_day", "last_day"], "performance_report": ["peak_day", "trough_day", "worst_month"],
}
SQL = {name: dated(sql, *_DATES[name]) if name in _DATES else sql for name, sql in SQL.items()}
