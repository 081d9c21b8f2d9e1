"""Index performance over (series, day, value): returns, volatility, drawdowns, growth rates, beta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_A_YEAR, TRADING_DAYS, MONTHS = 365.2425, 252, 12
#: Months that two series must share for a beta.
LEAST_MONTHS = 3


def _by_day() -> Window:
    return Window.partitionBy("series").orderBy("day")


def returns(points: DataFrame) -> DataFrame:
    """Adds ret, the simple return since the point before; null at the first."""
    return points.withColumn("ret", F.col("value") / F.lag("value").over(_by_day()) - 1)


def annual_volatility(ret: Column, periods: int) -> Column:
    """Sample deviation of the returns times the root of the periods a year; 0 with fewer than two."""
    return F.when(F.count(ret) < 2, F.lit(0.0)).otherwise(F.stddev_samp(ret) * F.sqrt(F.lit(float(periods))))


def volatility(points: DataFrame, periods: int = TRADING_DAYS) -> DataFrame:
    return returns(points).groupBy("series").agg(annual_volatility(F.col("ret"), periods).alias("volatility"))


def drawdowns(points: DataFrame) -> DataFrame:
    """Adds drawdown, and peak_day, the first day of the maximum so far."""
    order = _by_day().rowsBetween(Window.unboundedPreceding, 0)
    high = F.max(F.struct(F.col("value"), (-F.datediff("day", F.lit("1970-01-01").cast("date"))).alias("k"))).over(order)
    return points.withColumn("_high", high).withColumn("drawdown", F.col("value") / F.col("_high.value") - 1).withColumn("peak_day", F.date_sub(F.lit("1970-01-01").cast("date"), F.col("_high.k"))).drop("_high")


def max_drawdown(points: DataFrame) -> DataFrame:
    """(series, drawdown, peak_day, trough_day): the deepest one, the first of equals."""
    worst = F.min(F.struct("drawdown", F.col("day").alias("trough_day"), "peak_day"))
    return drawdowns(points).groupBy("series").agg(worst.alias("w")).select("series", "w.drawdown", "w.peak_day", "w.trough_day")


def month_ends(points: DataFrame) -> DataFrame:
    """(series, month, day, value) of the last point of each month."""
    last = F.max(F.struct("day", "value"))
    return points.groupBy("series", F.trunc("day", "month").alias("month")).agg(last.alias("l")).select("series", "month", "l.day", "l.value")


def growth(first: Column, last: Column, days: Column) -> Column:
    return F.when(days > 0, F.pow(last / first, DAYS_A_YEAR / days) - 1)


def _ends(points: DataFrame) -> DataFrame:
    at = lambda f: f(F.struct("day", "value"))
    return points.groupBy("series").agg(at(F.min).alias("a"), at(F.max).alias("b"), F.count("*").alias("observations"))


def cagr(points: DataFrame) -> DataFrame:
    days = F.datediff("b.day", "a.day")
    return _ends(points).select("series", growth(F.col("a.value"), F.col("b.value"), days).alias("cagr"), "observations")


def metrics(points: DataFrame) -> DataFrame:
    """Growth, volatility by days and by months, drawdown, part of months that gain, worst month."""
    monthly = returns(month_ends(points).select("series", "month", "day", "value"))
    months = monthly.where("ret IS NOT NULL").groupBy("series").agg(
        annual_volatility(F.col("ret"), MONTHS).alias("monthly_volatility"), (F.count_if(F.col("ret") > 0) / F.count("*")).alias("positive_months"),
        F.min(F.struct("ret", "month")).alias("w"),
    )
    months = months.select("series", "monthly_volatility", "positive_months", F.col("w.ret").alias("worst_month_return"), F.col("w.month").alias("worst_month"))
    return cagr(points).join(volatility(points), "series").join(max_drawdown(points), "series").join(months, "series", "left")


def value_at(points: DataFrame, start: Column, end: Column) -> DataFrame:
    """(series, first_day, first_value, last_day, last_value): on or after start, on or before end."""
    inside = points.where((F.col("day") >= start) & (F.col("day") <= end))
    return _ends(inside).select("series", F.col("a.day").alias("first_day"), F.col("a.value").alias("first_value"), F.col("b.day").alias("last_day"), F.col("b.value").alias("last_value"))


def period_return(points: DataFrame, start: str, end: str) -> DataFrame:
    found = value_at(points, F.lit(start).cast("date"), F.lit(end).cast("date"))
    return found.where("first_day < last_day").withColumn("period_return", F.col("last_value") / F.col("first_value") - 1)


def trailing_growth(points: DataFrame, years: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Growth over the last n years, from the first point on or after the day n years earlier (29 Feb counts as the 28th); no row if that is the last one."""
    last = _ends(points).select("series", F.col("b.day").alias("end_day"), F.col("b.value").alias("end_value"))
    asked = last.withColumn("years", F.explode(F.array(*[F.lit(y) for y in years]))).withColumn("start_target", F.add_months("end_day", -12 * F.col("years")))
    # As many rows a series as spans: the points meet them by series, and the earliest that is late enough stays.
    found = points.join(asked, "series").where((F.col("day") >= F.col("start_target")) & (F.col("day") < F.col("end_day"))).groupBy("series", "years", "end_day", "end_value").agg(F.min(F.struct("day", "value")).alias("s"))
    return found.select("series", "years", F.col("s.day").alias("start_day"), "end_day", growth(F.col("s.value"), F.col("end_value"), F.datediff("end_day", "s.day")).alias("cagr"))


def beta(points: DataFrame, benchmark: str) -> DataFrame:
    """Beta and correlation of monthly returns with those of the benchmark series, over common months."""
    monthly = month_ends(points)
    own = returns(monthly).where("ret IS NOT NULL").select("series", "month", "ret")
    base = own.where(F.col("series") == benchmark).select("month", F.col("ret").alias("base_ret"))
    both = own.where(F.col("series") != benchmark).join(base, "month").groupBy("series")
    found = both.agg(F.count("*").alias("months"), (F.covar_samp("ret", "base_ret") / F.var_samp("base_ret")).alias("beta"), F.corr("ret", "base_ret").alias("correlation"))
    return found.where(F.col("months") >= LEAST_MONTHS)


def common_range(points: DataFrame) -> DataFrame:
    """The points between the latest first and the earliest last day of all series."""
    spans = points.groupBy("series").agg(F.min("day").alias("a"), F.max("day").alias("b")).agg(F.max("a").alias("from_day"), F.min("b").alias("to_day"))
    return points.join(F.broadcast(spans)).where(F.col("day").between(F.col("from_day"), F.col("to_day"))).drop("from_day", "to_day")


def comparison(points: DataFrame, benchmark: str) -> DataFrame:
    """All metrics of every series over their common range, with beta to the benchmark."""
    shared = common_range(points)
    return metrics(shared).join(beta(shared, benchmark), "series", "left")
