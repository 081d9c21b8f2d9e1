"""Price bars: one per day, reactions to events against a benchmark, trend summaries.

Bars are (asset, ts, close). A group of bars is partitioned by asset, as are all windows here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trading days of the reaction windows.
WINDOWS = (1, 3, 5)
#: Bars of the short and long average, of the slope's distance, least bars of a summary.
SHORT, LONG, BACK, LEAST = 20, 60, 5, 60


def daily_bars(bars: DataFrame, tie: str = "ts") -> DataFrame:
    """(asset, day, ts, close): the latest bar of each UTC day."""
    last = F.max_by(F.struct("ts", "close"), F.struct("ts", tie))
    return bars.groupBy("asset", F.to_date("ts").alias("day")).agg(last.alias("bar")).select("asset", "day", "bar.ts", "bar.close")


def common_days(asset: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Days on which both have a bar, numbered from 1: (day, low_ts, high_ts, close, base_close, n) for each asset."""
    b = benchmark.select("day", F.col("ts").alias("base_ts"), F.col("close").alias("base_close"))
    both = asset.join(b, "day").select("asset", "day", F.least("ts", "base_ts").alias("low_ts"), F.greatest("ts", "base_ts").alias("high_ts"), "close", "base_close")
    return both.withColumn("n", F.row_number().over(Window.partitionBy("asset").orderBy("day")))


def _calendar(days: DataFrame, until, windows: tuple[int, ...]) -> DataFrame:
    """(asset, on, own_day, low_ts, high_ts, bar, before, n<k>...): for every calendar day the last common day up to it, with the bars around that one."""
    order = Window.partitionBy("asset").orderBy("day")
    bar = F.struct("day", "close", "base_close")
    near = {f"n{k}": F.lead(bar, k).over(order) for k in sorted({x for k in windows for x in (k, k - 1)})}
    rows = days.withColumns({"bar": bar, "before": F.lag(bar).over(order), "next": F.lead("day").over(order), **near})
    last = F.coalesce(F.date_sub("next", 1), F.greatest("day", F.lit(until)))
    return rows.select("asset", F.explode(F.sequence("day", last)).alias("on"), F.col("day").alias("own_day"), "low_ts", "high_ts", "bar", "before", *near)


def event_reactions(events: DataFrame, asset: DataFrame, benchmark: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Returns from the last common day wholly before an event to the k-th wholly at or after it, less the benchmark's.

    events(event_id, asset, event_ts). Days on which one bar is before and one after the event count for neither side.
    Events without a day before get no row; a window without its end has status 'pending'.

    Bars are of days, so an event meets the one calendar row of its own day, by asset and day; what comes before and after is in that row. Events are moved once and no asset's are in one task.
    """
    asked = events.select("event_id", "asset", "event_ts", F.to_date("event_ts").alias("on"))
    until = asked.agg(F.max("on")).first()[0]
    met = asked.join(_calendar(common_days(asset, benchmark), until, windows), ["asset", "on"])
    # Bars of an earlier day lie before the event; those of its own day are compared.
    own = F.col("on") > F.col("own_day")
    base = F.when(own | (F.col("high_ts") < F.col("event_ts")), F.col("bar")).otherwise(F.col("before"))
    passed = own | (F.col("low_ts") < F.col("event_ts"))
    ends = F.array(*[F.struct(F.lit(k).alias("window"), F.when(passed, F.col(f"n{k}")).otherwise(F.col(f"n{k - 1}")).alias("end")) for k in windows])
    rows = met.withColumn("base", base).where("base IS NOT NULL").select("event_id", "asset", "base", F.explode(ends).alias("w"))
    change = lambda c: F.col(f"w.end.{c}") / F.col(f"base.{c}") - 1
    return rows.select(
        "event_id", "asset", F.col("w.window").alias("window"), F.col("base.day").alias("baseline_day"), F.col("w.end.day").alias("end_day"), change("close").alias("asset_return"), change("base_close").alias("benchmark_return"),
        (change("close") - change("base_close")).alias("abnormal_return"), F.when(F.col("w.end").isNull(), "pending").otherwise("complete").alias("status"),
    )


def trend_summary(bars: DataFrame, least: int = LEAST) -> DataFrame:
    """Averages, slope, five-bar return and drawdown at each bar that has `least` bars up to it: (asset, day, ...)."""
    order = Window.partitionBy("asset").orderBy("day")
    avg = lambda a, b: F.avg("close").over(order.rowsBetween(a, b))
    short, earlier = avg(1 - SHORT, 0), avg(1 - SHORT - BACK, -BACK)
    return (
        bars.withColumn("n", F.row_number().over(order))
        .withColumn("sma_short", short)
        .withColumn("sma_long", avg(1 - LONG, 0))
        .withColumn("slope", F.col("sma_short") - earlier)
        .withColumn("return_5", F.col("close") / F.lag("close", BACK).over(order) - 1)
        .withColumn("drawdown", F.col("close") / F.max("close").over(order.rowsBetween(1 - LONG, 0)) - 1)
        .where(F.col("n") >= least)
        .drop("n")
    )


def trend_state(summary: DataFrame, severe: float = -0.10) -> DataFrame:
    """The watch, confirmed and severe conditions of a market alert at each bar."""
    weak, falling = F.col("close") < F.col("sma_short"), F.col("slope") < 0
    deep = (F.col("close") < F.col("sma_long")) & (F.col("sma_short") < F.col("sma_long")) & (F.col("drawdown") <= severe)
    return summary.withColumns({"watch": weak | falling, "confirmed": weak & falling, "severe": deep})


def confirmation(up: Column, expected: Column) -> Column:
    """Whether the observed direction is the expected one; null if either says nothing."""
    return F.when(up.isin("up", "down") & expected.isin("up", "down"), up == expected)
