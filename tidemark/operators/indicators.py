"""Indicators as window expressions over the rows of a series, ordered by time.

Every function gives a column; frames are in rows. A value is null until its frame is full.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by_time() -> WindowSpec:
    """The rows of a symbol in order of time."""
    return Window.partitionBy("symbol").orderBy("time")


def frame(lo: int, hi: int, series: WindowSpec | None = None) -> WindowSpec:
    return (series or by_time()).rowsBetween(lo, hi)


def full(value: Column, column: str, lo: int, hi: int, series: WindowSpec | None = None) -> Column:
    """value where the frame has all its rows."""
    return F.when(F.count(column).over(frame(lo, hi, series)) == hi - lo + 1, value)


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as SQL has it where b is 0: infinite, or no number if a is 0 too."""
    infinite = F.lit(float("inf"))
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, infinite).when(a < 0, -infinite)
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def ln(x: Column) -> Column:
    """The natural logarithm: no number below 0, infinitely low at 0."""
    return F.when(x < 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def sma(column: str, n: int, series: WindowSpec | None = None) -> Column:
    return full(F.avg(column).over(frame(1 - n, 0, series)), column, 1 - n, 0, series)


def true_range(series: WindowSpec | None = None) -> Column:
    before = F.lag("close").over(series or by_time())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def highest(column: str, n: int, series: WindowSpec | None = None) -> Column:
    """Over the n rows before this one."""
    return full(F.max(column).over(frame(-n, -1, series)), column, -n, -1, series)


def lowest(column: str, n: int, series: WindowSpec | None = None) -> Column:
    return full(F.min(column).over(frame(-n, -1, series)), column, -n, -1, series)


def left_low(n: int = 5, series: WindowSpec | None = None) -> Column:
    """Strictly below all of the n rows before."""
    return F.coalesce(F.col("low") < lowest("low", n, series), F.lit(False))


def left_high(n: int = 5, series: WindowSpec | None = None) -> Column:
    return F.coalesce(F.col("high") > highest("high", n, series), F.lit(False))


def swept_low(n: int = 10, series: WindowSpec | None = None) -> Column:
    """A low of the older half of the frame was pierced in the newer half, and the close is above it; false before the frame is full."""
    half = n // 2
    prior = F.min("low").over(frame(-n, -half - 1, series))
    return F.coalesce(full((F.min("low").over(frame(-half, 0, series)) < prior) & (F.col("close") > prior), "low", -n, 0, series), F.lit(False))


def relative(column: str, n: int = 20, series: WindowSpec | None = None) -> Column:
    """The value over the mean of the n rows before."""
    mean = F.avg(column).over(frame(-n, -1, series))
    return full(F.try_divide(F.col(column), F.nullif(mean, F.lit(0.0))), column, -n, -1, series)


def range_position(n: int = 20, series: WindowSpec | None = None) -> Column:
    lo, hi = F.min("low").over(frame(-n, 0, series)), F.max("high").over(frame(-n, 0, series))
    return F.when(hi > lo, (F.col("close") - lo) / (hi - lo))


def above_mean_before(column: str, n: int, factor: float = 1.0, series: WindowSpec | None = None) -> Column:
    """Whether the value is above factor times the mean of the n rows before; false without them."""
    return F.coalesce(full(F.col(column) > factor * F.avg(column).over(frame(-n, -1, series)), column, -n, -1, series), F.lit(False))


def change(column: str, n: int, series: WindowSpec | None = None) -> Column:
    base = F.lag(column, n).over(series or by_time())
    return F.when(base != 0, F.col(column) / base - 1)


def volatility(column: str, n: int, series: WindowSpec | None = None) -> Column:
    """Population deviation of a column of returns."""
    return full(F.stddev_pop(column).over(frame(1 - n, 0, series)), column, 1 - n, 0, series)


def beta(own: str, factor: str, n: int, series: WindowSpec | None = None) -> Column:
    w = frame(1 - n, 0, series)
    return full(F.covar_pop(own, factor).over(w) / F.nullif(F.var_pop(factor).over(w), F.lit(0.0)), own, 1 - n, 0, series)


def hysteresis(value: Column, band: float, series: WindowSpec | None = None, start: Column | None = None) -> Column:
    """1 above the band, -1 below, inside it the state before; ``start`` until the band is left first."""
    outside = F.when(value > band, 1).when(value < -band, -1)
    held = F.last(outside, ignorenulls=True).over((series or by_time()).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(held, start if start is not None else F.lit(0))


def drawdown(value: str, floor: float = 0.0, ratio: bool = False, series: WindowSpec | None = None) -> Column:
    """Distance below the running peak, which begins at ``floor``; as a share of the peak with ``ratio``."""
    peak = F.greatest(F.lit(floor), F.max(value).over((series or by_time()).rowsBetween(Window.unboundedPreceding, 0)))
    return (F.col(value) - peak) / peak if ratio else F.col(value) - peak


def regime(column: str = "close", n: int = 200, band: float = 0.01, series: WindowSpec | None = None) -> Column:
    mean = sma(column, n, series)
    return F.when(mean.isNull(), "unknown").when(F.col(column) > mean * (1 + band), "bull").when(F.col(column) < mean * (1 - band), "bear").otherwise("flat")
