"""Cash-secured put contracts: rejections, metrics of what passes, and the capacity that an account leaves. Money is decimal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the gate. Fixed values.
DTE, DELTA, SPREAD, OPEN_INTEREST, VOLUME = (21, 60), (0.10, 0.30), 0.08, 500, 50
QUOTE_AGE = {"realtime": 15, "delayed": 1800, "end_of_day": 345_600}
ACCOUNT_AGE = 60


def rejections(c: dict[str, Column]) -> Column:
    """The codes of all that is wrong with a contract, in order; c has its fields as columns."""
    age = F.lit(0)
    for mode, most in QUOTE_AGE.items():
        age = F.when(c["mode"] == mode, most).otherwise(age)
    bad = [
        ("dte_missing", c["dte"].isNull()), ("dte_too_short", c["dte"] < DTE[0]), ("dte_too_long", c["dte"] > DTE[1]),
        ("delta_missing", c["delta"].isNull()), ("delta_not_negative", c["delta"] >= 0), ("delta_too_small", F.abs(c["delta"]) < DELTA[0]), ("delta_too_large", F.abs(c["delta"]) > DELTA[1]),
        ("bid_not_positive", c["bid"] <= 0), ("ask_below_bid", c["ask"] < c["bid"]), ("spread_too_wide", (c["bid"] > 0) & (c["ask"] - c["bid"] > c["bid"] * SPREAD)),
        ("open_interest_too_low", c["open_interest"] < OPEN_INTEREST), ("volume_too_low", c["volume"] < VOLUME), ("mode_unknown", ~c["mode"].isin(*QUOTE_AGE)),
        ("quote_stale", c["quote_age"] > age), ("quote_from_future", c["quote_age"] < 0), ("account_stale", c["account_age"] > ACCOUNT_AGE), ("earnings_before_expiry", c["earnings_in"] <= c["dte"]),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in bad]))


def evaluate(contracts: DataFrame) -> DataFrame:
    """Adds rejections, and reserve, premium, breakeven, cushion and annualised yield where there are none."""
    c = {name: F.col(name) for name in contracts.columns}
    money = lambda x: x.cast("decimal(18,4)")
    out = contracts.withColumn("rejections", rejections(c))
    ok = F.size("rejections") == 0
    breakeven = money(c["strike"]) - money(c["bid"])
    return out.withColumns({
        "reserve": F.when(ok, money(c["strike"]) * 100), "premium": F.when(ok, money(c["bid"]) * 100), "breakeven": F.when(ok, breakeven),
        "cushion": F.when(ok, (c["price"] - breakeven.cast("double")) / c["price"]), "annualised": F.when(ok, c["bid"] / c["strike"] * 365 / c["dte"]),
    })


def capacity(accounts: DataFrame) -> DataFrame:
    """accounts(nlv, cash, buying_power, existing, ceiling: decimals; total_bps, single_bps, buffer_bps, weekly_left: ints) with the limits and the first reason to abstain.

    Shares of the net value are cut to cents, the buffer is rounded up to cents.
    """
    cents = lambda x: F.floor(x * 100) / 100
    share = lambda bps: F.col("nlv") * F.col(bps) / 10_000
    d = lambda x: x.cast("decimal(18,2)")
    a = accounts.withColumns({"total_limit": d(cents(share("total_bps"))), "single_limit": d(cents(share("single_bps"))), "buffer": d(F.ceil(share("buffer_bps") * 100) / 100)})
    a = a.withColumn("room", F.greatest(d(F.lit(0)), F.least(F.col("buying_power"), F.col("cash") - F.col("buffer"))))
    a = a.withColumn("effective", d(F.least(F.col("ceiling"), F.col("total_limit"), F.col("existing") + F.col("room"))))
    reason = (
        F.when(F.col("cash") < F.col("buffer"), "cash_buffer_breached").when(F.col("existing") > F.least("ceiling", "total_limit"), "existing_collateral_limit_breached")
        .when(F.col("weekly_left") <= 0, "weekly_new_contract_limit_reached").when(F.col("effective") <= F.col("existing"), "new_capacity_unavailable")
    )
    return a.withColumn("remaining", d(F.col("effective") - F.col("existing"))).withColumn("abstain", reason)
