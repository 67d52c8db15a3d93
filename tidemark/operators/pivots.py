"""Swing pivots: the lowest flagged low since the last pivot is confirmed by a close above its bar, the highest high likewise.

A pivot ends what is known of the bars before it, so a series falls apart at its pivots. Each series is one Arrow group, which
goes from pivot to pivot: running extremes of a stretch and the first close beyond them are array operations on it. The
same group smooths the changes of the close (RSI), which needs the whole series too. What a window can
express (the flags, the last pivots) stays in SQL. A series must fit in a task: a symbol's hour bars of a
century are some 900,000 rows of 60 bytes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators.joins import numbered

BARS = "symbol string, time long, i long, open double, high double, low double, close double, volume double"
STATE = f"{BARS}, pivot string, pivot_i long, pivot_price double, cand_i long, cand_price double, cand_trigger double, rsi double"


def _running_lowest(value: np.ndarray, flagged: np.ndarray) -> np.ndarray:
    """Per place the first place of the lowest flagged value so far; -1 before any."""
    held = np.where(flagged, value, np.inf)
    lowest = np.minimum.accumulate(held)
    fresh = held < np.append(np.inf, lowest[:-1])
    return np.maximum.accumulate(np.where(fresh, np.arange(len(value)), -1))


def _next_pivot(low: np.ndarray, high: np.ndarray, close: np.ndarray, is_low: np.ndarray, is_high: np.ndarray) -> tuple[int, str | None, int, np.ndarray]:
    """The first bar of a stretch that confirms a pivot, its kind and bar, and the lowest low known after each bar.

    The bar is the stretch's length where there is none.
    """
    bottom, top = _running_lowest(low, is_low), _running_lowest(-high, is_high)
    here = np.arange(len(low))
    up = (bottom >= 0) & (bottom < here) & (close > high[bottom])
    down = (top >= 0) & (top < here) & (close < low[top])
    found = np.flatnonzero(up | down)
    if not len(found):
        return len(low), None, -1, bottom
    k = int(found[0])
    return (k, "low", int(bottom[k]), bottom) if up[k] else (k, "high", int(top[k]), bottom)


def _smoothed(close: np.ndarray, n: int = 14) -> list[float | None]:
    """RSI: the mean of the first n changes, then each change with weight 1/n."""
    moves = np.diff(close)
    out: list[float | None] = [None] * len(close)
    if len(moves) < n:
        return out
    gain, loss = np.maximum(moves, 0), np.maximum(-moves, 0)
    up, down = gain[:n].mean(), loss[:n].mean()
    for k in range(n, len(close)):
        if k > n:
            up, down = (up * (n - 1) + gain[k - 1]) / n, (down * (n - 1) + loss[k - 1]) / n
        out[k] = 100.0 if down == 0 else float(100 - 100 / (1 + up / down))
    return out


def with_pivots(bars: DataFrame, n: int = 5) -> DataFrame:
    """Bars with the pivot each confirms, if any, the unconfirmed low known before it (cand_*), and RSI over 14 bars."""
    flagged = numbered(bars).withColumns({"is_low": I.left_low(n), "is_high": I.left_high(n)})
    columns = [f.split()[0] for f in BARS.split(", ")]

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        low, high, close = (table.column(c).to_numpy() for c in ("low", "high", "close"))
        is_low, is_high = (np.asarray(table.column(c)) for c in ("is_low", "is_high"))
        size, begin, length = len(low), 0, 64
        known = np.full(size, -1)
        pivots: dict[str, list] = {"pivot": [None] * size, "pivot_i": [None] * size, "pivot_price": [None] * size}
        while begin < size:
            part = slice(begin, min(size, begin + length))
            k, kind, at, bottom = _next_pivot(low[part], high[part], close[part], is_low[part], is_high[part])
            if kind is None and part.stop < size:
                length *= 2  # looked at again from its beginning, twice as far
                continue
            seen = bottom[: min(k, len(bottom) - 1)]
            known[begin + 1 : begin + 1 + len(seen)] = np.where(seen >= 0, seen + begin, -1)
            if kind is not None:
                at += begin
                pivots["pivot"][begin + k], pivots["pivot_i"][begin + k], pivots["pivot_price"][begin + k] = kind, at, float((low if kind == "low" else high)[at])
            begin, length = begin + k + 1, 64
        none = known < 0
        more = [pa.array(pivots["pivot"], pa.string()), pa.array(pivots["pivot_i"], pa.int64()), pa.array(pivots["pivot_price"], pa.float64()), pa.array(known, pa.int64(), mask=none)]
        more += [pa.array(v[known], pa.float64(), mask=none) for v in (low, high)]
        more.append(pa.array(_smoothed(close), pa.float64()))
        return pa.Table.from_arrays([table.column(c).combine_chunks() for c in columns] + more, [f.split()[0] for f in STATE.split(", ")])

    return flagged.select(*columns, "is_low", "is_high").groupBy("symbol").applyInArrow(fold, STATE)


def _last(value: Column, when: Column) -> Column:
    return F.last(F.when(when, value), ignorenulls=True).over(I.by_time().rowsBetween(Window.unboundedPreceding, 0))


def with_bias(pivoted: DataFrame) -> DataFrame:
    """bias after each bar: bull after a confirmed low, bear after a high, null before any."""
    return pivoted.withColumn("bias", F.when(_last(F.col("pivot"), F.col("pivot").isNotNull()) == "low", "bull").when(_last(F.col("pivot"), F.col("pivot").isNotNull()) == "high", "bear"))


def with_trend(pivoted: DataFrame) -> DataFrame:
    """trend after each bar: the last two confirmed lows rise and so do the last two highs."""
    typed = Window.partitionBy("symbol", "pivot").orderBy("i")
    rising = F.col("pivot_price") > F.lag("pivot_price").over(typed)
    marked = pivoted.withColumn("rises", F.when(F.col("pivot").isNotNull(), F.coalesce(rising, F.lit(False))))
    both = [F.coalesce(_last(F.col("rises"), F.col("pivot") == kind), F.lit(False)) for kind in ("low", "high")]
    return marked.withColumn("trend", both[0] & both[1]).drop("rises")


def with_resistance(pivoted: DataFrame) -> DataFrame:
    """symbol, i, resistance of every bar: the lowest high confirmed before the bar that is above its close, or null.

    The confirmed prices of a series are kept in order, so a bar is one search and not a comparison with
    every high before it.
    """

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        highs: list[float] = []
        out: list[float | None] = []
        for close, price in zip(table.column("close").to_pylist(), table.column("p").to_pylist(), strict=True):
            at = bisect_right(highs, close)
            out.append(highs[at] if at < len(highs) else None)
            if price is not None:
                insort(highs, price)
        return pa.Table.from_arrays([table.column("symbol").combine_chunks(), table.column("i").combine_chunks(), pa.array(out, pa.float64())], ["symbol", "i", "resistance"])

    highs = F.when(F.col("pivot") == "high", F.col("pivot_price")).alias("p")
    return pivoted.select("symbol", "i", "close", highs).groupBy("symbol").applyInArrow(fold, "symbol string, i long, resistance double")


def touched_support(pivoted: DataFrame, above: float = 0.004, below: float = 0.02) -> DataFrame:
    """symbol, i, support: of the lows confirmed before the bar, the nearest one that its low touches, the first of equals; touched bars only.

    A touch is a low from ``below`` under the price to ``above`` over it. The distinct confirmed prices of a series are kept in order, each with
    its first bar, so a bar asks its two neighbours and isn't compared with every low before it.
    """

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        prices: list[float] = []
        first: dict[float, int] = {}
        out: list[float | None] = []
        for i, low, price in zip(*(table.column(c).to_pylist() for c in ("i", "low", "p")), strict=True):
            at = bisect_left(prices, low)
            near = [p for p in prices[max(0, at - 1) : at + 1] if (1 - below) * p <= low <= (1 + above) * p]
            out.append(min(near, key=lambda p: (abs(low - p), first[p])) if near else None)  # noqa: B023
            if price is not None and price not in first:
                first[price] = i
                insort(prices, price)
        found = pa.Table.from_arrays([table.column("symbol").combine_chunks(), table.column("i").combine_chunks(), pa.array(out, pa.float64())], ["symbol", "i", "support"])
        return found.filter(pa.array([x is not None for x in out], pa.bool_()))

    lows = F.when(F.col("pivot") == "low", F.col("pivot_price")).alias("p")
    return pivoted.select("symbol", "i", "low", lows).groupBy("symbol").applyInArrow(fold, "symbol string, i long, support double")


def wilder_rsi(bars: DataFrame) -> DataFrame:
    """symbol, time, rsi: seeded with the mean of the first 14 changes, then smoothed by 1/14."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("time")
        rsi = pa.array(_smoothed(table.column("close").to_numpy()), pa.float64())
        return pa.Table.from_arrays([table.column("symbol").combine_chunks(), table.column("time").combine_chunks(), rsi], ["symbol", "time", "rsi"])

    return bars.select("symbol", "time", "close").groupBy("symbol").applyInArrow(fold, "symbol string, time long, rsi double")
