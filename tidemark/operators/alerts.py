"""Market alerts: a state machine over the days of each market, with confirmation by two days and slow recovery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIONS = ("observe", "prepare_reduce", "reduce_candidate", "exit_candidate")
#: Days kept in a list, days that confirm.
KEPT, CONFIRM = 3, 2
_RANK = {a: k for k, a in enumerate(ACTIONS)}
#: Level of each action, and the version of the rules that a kept state must have.
LEVELS, VERSION = ("low", "medium", "high", "critical"), "alerts-2"


def pressures(vix: Column, stress: Column, usd_cny: Column | None = None, cny_change: Column | None = None) -> tuple[Column, Column, Column]:
    """(strong, critical, whether the currency is critical): how many pressure readings are so."""
    one = lambda c: F.when(c, 1).otherwise(0)
    strong, critical, fx = one(vix >= 28) + one(stress > 2), one(vix >= 35) + one(stress > 5), F.lit(True)
    if usd_cny is not None:
        strong = strong + one((usd_cny >= 7.20) & (cny_change >= 0.005))
        fx = F.coalesce((usd_cny >= 7.30) & (cny_change >= 0.01), F.lit(False))
        critical = critical + one(fx)
    return strong, critical, fx


class State:
    """What a market carries from one evaluation to the next. A state kept under another VERSION is as none."""

    def __init__(self, action: str = ACTIONS[0], reduce: tuple = (), exit: tuple = (), recovery: tuple = (), last=None):
        self.action, self.reduce, self.exit, self.recovery, self.last = action, list(reduce), list(exit), list(recovery), last

    @staticmethod
    def _with(days: list, day) -> list:
        """Different days of a condition; an evaluation later on the same day adds none."""
        return (days if day in days else [*days, day])[-KEPT:]

    def step(self, day, valid: bool, watch: bool, confirmed: bool, severe: bool, strong: int, critical: int, fx: bool) -> tuple[str, str, bool]:
        """(action, level, whether a fall waits for its second day) of an evaluation; one of a day before the last is answered and changes nothing."""
        if self.last is not None and day < self.last:
            return self.action, LEVELS[_RANK[self.action]], False
        self.last = day
        if not valid:
            # Stale or missing inputs: nothing that was confirmed counts any more.
            self.action, self.reduce, self.exit, self.recovery = ACTIONS[0], [], [], []
            return self.action, "insufficient", False
        raw_reduce, raw_exit = confirmed and strong > 0, severe and critical >= 2 and fx
        self.reduce = self._with(self.reduce, day) if raw_reduce or raw_exit else []
        self.exit = self._with(self.exit, day) if raw_exit else []
        before, action = self.action, ACTIONS[1] if raw_reduce or raw_exit or watch or strong > 0 else ACTIONS[0]
        if len(self.reduce) >= CONFIRM:
            action = ACTIONS[2]
        if len(self.exit) >= CONFIRM and _RANK[before] >= 2:
            action = ACTIONS[3]
        recovery, pending = [], False
        if _RANK[before] > _RANK[action]:
            if (before == ACTIONS[2] and (raw_reduce or raw_exit)) or (before == ACTIONS[3] and raw_exit):
                action = before
            else:
                recovery = self._with(self.recovery, day)
                if len(recovery) < CONFIRM:
                    action, pending = before, True
        self.action, self.recovery = action, recovery
        return action, LEVELS[_RANK[action]], pending


_FIELDS = ("valid", "watch", "confirmed", "severe", "strong", "critical", "fx")
_RESULT = "market string, day date, action string, level string, pending boolean"


def replay(days: DataFrame) -> DataFrame:
    """days(market, day, valid, watch, confirmed, severe, strong, critical, fx) -> (market, day, action, level, pending).

    The days of a market arrive in order (several evaluations of a day by their values) and go through the state one at a time; a task holds a batch of them and one state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        market, state = None, State()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.market != market:
                    market, state = row.market, State()
                out.append((row.market, row.day, *state.step(row.day, *(getattr(row, f) for f in _FIELDS))))
            yield pd.DataFrame(out, columns=["market", "day", "action", "level", "pending"])

    columns = days.select("market", "day", *_FIELDS)
    return columns.repartition("market").sortWithinPartitions("market", "day", *_FIELDS).mapInPandas(run, _RESULT)


class MarketProcessor(StatefulProcessor):
    """The state of each market as a value of the stream's store: version, action and days."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("alert", "version string, action string, reduce array<date>, exit array<date>, recovery array<date>, last date")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.value.get() if self.value.exists() else None
        state = State(*kept[1:]) if kept is not None and kept[0] == VERSION else State()
        found = pd.concat(list(rows), ignore_index=True).sort_values(["day", *_FIELDS], kind="stable")
        out = [(row.market, row.day, *state.step(row.day, *(getattr(row, f) for f in _FIELDS))) for row in found.itertuples(index=False)]
        self.value.update((VERSION, state.action, state.reduce, state.exit, state.recovery, state.last))
        yield pd.DataFrame(out, columns=["market", "day", "action", "level", "pending"])

    def close(self) -> None:
        pass


def follow(days: DataFrame) -> DataFrame:
    """replay for a stream of days: each micro-batch goes on from what the markets' states hold. Asks for the RocksDB state store."""
    columns = days.select("market", "day", *_FIELDS)
    return columns.groupBy("market").transformWithStateInPandas(MarketProcessor(), outputStructType=_RESULT, outputMode="Update", timeMode="None")


def indicator_events(snapshots: DataFrame) -> DataFrame:
    """snapshots(market, day, vix, stress, curve, dollar) -> an event for each move against the snapshot before: (market, day, kind, value)."""
    w = Window.partitionBy("market").orderBy("day")
    before = {c: F.lag(c).over(w) for c in ("vix", "stress", "curve", "dollar")}
    s = snapshots.withColumns({f"_{c}": v for c, v in before.items()})
    crossed = lambda c, x: (F.col(f"_{c}") < x) != (F.col(c) < x)
    moved = lambda c: F.abs(F.col(c) - F.col(f"_{c}"))
    event = lambda cond, kind, c: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")))
    found = F.array(
        event((moved("vix") >= 3) | ((F.col("_vix") < 25) & (F.col("vix") >= 25)), "vix", "vix"), event((moved("stress") >= 1) | crossed("stress", 0) | crossed("stress", 2) | crossed("stress", 5), "stress", "stress"),
        event(F.signum("_curve") * F.signum("curve") < 0, "curve", "curve"), event(F.abs(F.col("dollar") / F.col("_dollar") - 1) >= 0.01, "dollar", "dollar"),
    )
    return s.select("market", "day", F.explode(F.array_compact(found)).alias("e")).select("market", "day", "e.kind", "e.value")
