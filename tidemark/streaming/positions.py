"""Open positions as state of a stream: a stop that rises, a target, and a time limit of event time.

A row of the stream is a price of a symbol and may carry a signal (stop and target of a position to be opened at that
price). The state of a symbol is its one open position. It is kept by transformWithState in the state store: a restarted
query goes on with the stops as they stood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "entry double, stop double, target double, opened long, raised boolean, last double"
CLOSED = "symbol string, opened_at long, closed_at long, entry double, price double, reason string, stop double"


@dataclass(frozen=True)
class Rules:
    """When a position ends, and when its stop is raised once: far enough above the entry to pay the costs.

    hold: seconds of event time after which it is closed at the last price.
    """

    hold: int = 24 * 3600
    arm_r: float = 1.0
    lock_r: float = 0.2
    fee_buffer: float = 0.01

    def opened(self, price: float, stop: float, target: float, at: int) -> tuple:
        return (price, stop, target, at, False, price)

    def step(self, held: tuple, price: float) -> tuple[tuple, str | None]:
        """The position after a price, and why it ends there, if it does: the stop as it stood goes first, then the target."""
        entry, stop, target, at, raised, _ = held
        if price <= stop:
            return held, "stop"
        if price >= target:
            return held, "target"
        if not raised and entry > stop:
            lock = max(self.lock_r * (entry - stop), self.fee_buffer * entry)
            if price >= entry + max(self.arm_r * (entry - stop), lock + 0.5 * (entry - stop)):
                return (entry, entry + lock, target, at, True, price), None
        return (entry, stop, target, at, raised, price), None


class Keeper(StatefulProcessor):
    """One open position of a symbol; rows of a micro-batch are taken in order of event time."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("position", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        before, closed = held, []
        for row in pd.concat(rows).sort_values(["at", "event_id"]).itertuples():
            if held and row.at >= held[3] + self.rules.hold * 1_000_000:
                closed.append(self._closed(key, held, held[3] + self.rules.hold * 1_000_000, held[5], "timeout"))
                held = None
            if held:
                held, reason = self.rules.step(held, row.price)
                if reason:
                    closed.append(self._closed(key, held, row.at, row.price, reason))
                    held = None
            elif not pd.isna(row.stop) and row.stop < row.price:
                held = self.rules.opened(row.price, row.stop, row.target, int(row.at))
        if before and (held is None or held[3] != before[3]):
            self.handle.deleteTimer(self._due(before))
        if held:
            self.held.update(held)
            if not before or held[3] != before[3]:
                self.handle.registerTimer(self._due(held))
        else:
            self.held.clear()
        if closed:
            yield pd.DataFrame(closed, columns=[c.split()[0] for c in CLOSED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the limit and no row has come that would have closed the position."""
        held = tuple(self.held.get()) if self.held.exists() else None
        if held and self._due(held) <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield pd.DataFrame([self._closed(key, held, held[3] + self.rules.hold * 1_000_000, held[5], "timeout")], columns=[c.split()[0] for c in CLOSED.split(", ")])

    def close(self) -> None:
        pass

    def _due(self, held: tuple) -> int:
        return held[3] // 1000 + self.rules.hold * 1000

    def _closed(self, key, held: tuple, at: int, price: float, reason: str) -> tuple:
        return (key[0], held[3], int(at), held[0], float(price), reason, held[1])


def positions(prices: DataFrame, rules: Rules = Rules(), late: str = "10 minutes") -> DataFrame:
    """The closed positions of a stream (symbol, ts, event_id, price, and stop and target of a signal or null); times in microseconds.

    A signal counts only while the symbol has no open position, and if its stop is below the price. Positions still open when the stream ends stay in the
    state, which is RocksDB's: its provider is set for the session.
    """
    spark = prices.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = prices.withWatermark("ts", late).selectExpr("symbol", "ts", "unix_micros(ts) AS at", "event_id", "cast(price AS double) AS price", "cast(stop AS double) AS stop", "cast(target AS double) AS target")
    return told.groupBy("symbol").transformWithStateInPandas(Keeper(rules), CLOSED, "append", "EventTime")
