"""Entry rules: per bar the entry and stop of a long position, or null.

Each rule is a pair of columns over numbered bars with the columns of prepared(); gates turn a candidate into a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators import pivots as P
from tidemark.operators.joins import first_passage


def prepared(bars: DataFrame, n: int = 5) -> DataFrame:
    """Bars with what the rules need: averages, ATR, RSI, extremes, pivots; one shuffle by symbol."""
    one = P.with_pivots(bars, n).withColumns(
        {
            "tr": I.true_range(), "sma20": I.sma("close", 20), "sma50": I.sma("close", 50), "top20": I.highest("high", 20), "low6": F.min("low").over(I.frame(-5, 0)),
            "low12": I.lowest("low", 12), "low24": I.lowest("low", 24), "vol20": F.avg("volume").over(I.frame(-20, -1)), "rsi_before": F.lag("rsi").over(I.by_time()),
        }
    )
    lows = F.when(F.col("pivot") == "low", F.col("pivot_price"))
    typed = Window.partitionBy("symbol", "pivot").orderBy("i")
    two = one.withColumns({"atr": I.sma("tr", 14), "low_rises": F.when(F.col("pivot") == "low", F.coalesce(F.col("pivot_price") > F.lag("pivot_price").over(typed), F.lit(False)))})
    running = I.by_time().rowsBetween(Window.unboundedPreceding, 0)
    return two.withColumns(
        {
            "atr_before": F.lag("atr").over(I.by_time()), "close_before": F.lag("close").over(I.by_time()), "sma20_before": F.lag("sma20").over(I.by_time()),
            "lows_rise_before": F.coalesce(F.last("low_rises", ignorenulls=True).over(I.by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)),
            "last_low": F.last(lows, ignorenulls=True).over(running), "lows_rise": F.coalesce(F.last("low_rises", ignorenulls=True).over(running), F.lit(False)),
        }
    )


def with_levels(bars: DataFrame) -> DataFrame:
    """prepared() bars with support (the low that the bar touches) and resistance (the lowest high above its close)."""
    return bars.join(P.touched_support(bars), ["symbol", "i"], "left").join(P.with_resistance(bars), ["symbol", "i"], "left")


def with_contraction(bars: DataFrame, ratio: float = 0.5, span: int = 50, least: int = 5) -> DataFrame:
    """prepared() bars with squeeze_high and squeeze_low: the range of the run of quiet bars before the bar, or null.

    A bar is quiet if the ATR before it is under ``ratio`` of the median ATR of the ``span`` bars before; a run has
    ``least`` bars or more and counts its last ``span``.
    """
    ranked = bars.withColumn("__atrs", F.array_sort(F.collect_list("atr").over(I.frame(-span, -1))))
    n = F.size("__atrs")
    median = (F.try_element_at("__atrs", F.floor((n + 1) / 2).cast("int")) + F.try_element_at("__atrs", F.floor(n / 2).cast("int") + 1)) / 2
    marked = ranked.withColumn("__quiet", F.when(n > 0, F.coalesce(F.col("atr_before") < ratio * median, F.lit(False))).otherwise(False)).drop("__atrs")
    noisy = F.max(F.when(~F.col("__quiet"), F.col("i"))).over(I.by_time().rowsBetween(Window.unboundedPreceding, -1))
    length = F.least(F.lit(span), F.col("i") - 1 - F.coalesce(noisy, F.lit(-1))).cast("int")
    held = marked.withColumns({"__run": length, "__highs": F.collect_list("high").over(I.frame(-span, -1)), "__lows": F.collect_list("low").over(I.frame(-span, -1))})
    within = lambda c: F.when(F.col("__run") >= least, F.slice(c, -F.col("__run"), F.col("__run")))
    return held.withColumns({"squeeze_high": F.array_max(within("__highs")), "squeeze_low": F.array_min(within("__lows"))}).drop("__quiet", "__run", "__highs", "__lows")


def aligned(biases: list[Column], mode: str) -> Column:
    """Whether the biases of higher intervals, nearest first, allow an entry.

    none: always; first: the nearest is bull; notbear: none is bear; all: each is bull. A bias not known yet is neither.
    """
    if mode == "none" or not biases:
        return F.lit(True)
    if mode == "first":
        return F.coalesce(biases[0] == "bull", F.lit(False))
    each = F.array(*biases)
    if mode == "notbear":
        return F.forall(each, lambda b: F.coalesce(b != "bear", F.lit(True)))
    return F.forall(each, lambda b: F.coalesce(b == "bull", F.lit(False)))


def _touches() -> Column:
    """Lows of the 20 bars before within half a percent of the 24-bar low."""
    return F.size(F.filter(F.collect_list("low").over(I.frame(-20, -1)), lambda x: x <= 1.005 * F.col("low24")))


def rule(mode: str) -> tuple[Column, Column, Column]:
    """Trigger, entry and stop of a mode. support and rev need with_levels(), vol_contraction needs with_contraction()."""
    c, low = F.col("close"), F.col("low")
    known = {
        "bos": (F.col("pivot") == "low", c, F.col("pivot_price")),
        "ma_dip": (c < 0.98 * F.col("sma20"), c, low * 0.999),
        "rsi": ((F.col("rsi_before") < 30) & (F.col("rsi") >= 30), c, F.col("low6") * 0.999),
        "breakout": (c > F.col("top20"), c, c - 2 * F.col("atr_before")),
        "trend_pullback": ((F.col("sma20") > F.col("sma50")) & (F.col("close_before") <= F.col("sma20_before")) & (c > F.col("sma20")), c, F.col("low6") * 0.999),
        "sweep_reclaim": ((low < F.col("low12")) & (c > F.col("low12")) & (c > F.col("open")), c, low - 0.25 * F.col("atr_before")),
        "h3": (F.col("lows_rise") & (c > F.col("last_low")), c, F.least(low, F.col("last_low"))),
        "range_sweep_reclaim": (
            (F.col("i") >= 50) & (low < F.col("low24")) & (c > F.col("low24")) & (F.abs(I.ratio(F.col("sma20"), F.col("sma50")) - 1) <= 0.02) & (F.col("volume") >= 1.2 * F.col("vol20")) & (_touches() >= 2),
            c, low - 0.25 * F.col("atr_before"),
        ),
        "support": (c > F.col("support"), c, F.least(low, F.col("support")) - 0.001 * c),
        "rev": ((c > F.col("support")) & F.coalesce(F.col("lows_rise_before"), F.lit(False)), c, F.least(low, F.col("support")) - 0.001 * c),
        "vol_contraction": (c > F.col("squeeze_high"), c, F.col("squeeze_low") - 0.001 * c),
    }
    return known[mode]


MODES = ("bos", "ma_dip", "rsi", "breakout", "trend_pullback", "sweep_reclaim", "h3", "range_sweep_reclaim", "support", "rev", "vol_contraction")


def candidates(bars: DataFrame, mode: str, max_stop: float | None = 0.06, min_stop: float | None = 0.01, gate: Column | None = None, trend: Column | None = None, target_r: float = 4.0) -> DataFrame:
    """symbol, i, time, entry, stop, target, reason of each bar at which the mode triggers.

    The reason is the first gate in this order that holds it back: stop not below the price, too far, too near, trend,
    the external gate. target: the resistance above for support and rev, where there is one, else a multiple of the risk.
    """
    trigger, entry, stop = rule(mode)
    found = bars.withColumns({"__on": trigger, "entry": entry, "stop": stop}).filter("__on and stop is not null")
    share = I.ratio(F.col("entry") - F.col("stop"), F.col("entry"))
    reason = F.when(F.col("stop") >= F.col("entry"), "price_below_stop")
    reason = reason.when(share > max_stop, "stop_too_far") if max_stop else reason
    reason = reason.when(share < min_stop, "stop_too_tight") if min_stop else reason
    reason = reason.when(~F.coalesce(trend, F.lit(False)), "trend_gate") if trend is not None else reason
    reason = reason.when(~F.coalesce(gate, F.lit(False)), "external_gate") if gate is not None else reason
    target = F.col("entry") + target_r * (F.col("entry") - F.col("stop"))
    target = F.coalesce("resistance", target) if mode in ("support", "rev") else target
    return found.select("symbol", "i", "time", "entry", "stop", target.alias("target"), reason.otherwise("taken").alias("reason"))


def every_candidate(bars: DataFrame, modes: tuple[str, ...] = MODES, **options) -> DataFrame:
    """The taken candidates of all modes, with mode. bars: prepared() with_levels() with_contraction()."""
    parts = None
    for mode in modes:
        found = candidates(bars, mode, **options).filter("reason = 'taken'").withColumn("mode", F.lit(mode))
        parts = found if parts is None else parts.unionByName(found)
    return parts


def break_reasons(bars: DataFrame, align: Column, trend: Column | None = None, max_stop: float = 0.06, min_stop: float = 0.01, higher_low: bool = True, room: float = 2.0) -> DataFrame:
    """symbol, i, entry, stop, reason of each confirmed low, with the gates of structure.

    In order: stop not below the price, biases not aligned, trend, stop too far, too near, no higher low, no room: the
    resistance is nearer than so many times the risk. bars: with_levels().
    """
    entry, stop = F.col("close"), F.col("pivot_price")
    share, risk = I.ratio(entry - stop, entry), entry - stop
    reason = F.when(stop >= entry, "price_below_stop").when(~F.coalesce(align, F.lit(False)), "not_aligned")
    reason = reason.when(~F.coalesce(trend, F.lit(False)), "trend_gate") if trend is not None else reason
    reason = reason.when(share > max_stop, "stop_too_far").when(share < min_stop, "stop_too_tight")
    reason = reason.when(~F.col("low_rises"), "not_higher_low") if higher_low else reason
    reason = reason.when(F.col("resistance") - entry < room * risk, "no_room").otherwise("taken")
    return bars.filter("pivot = 'low'").select("symbol", "i", entry.alias("entry"), stop.alias("stop"), reason.alias("reason"))


def profile(bars: DataFrame, entries: DataFrame, horizon: int = 300) -> DataFrame:
    """Labelled rows for a classifier: symbol, i, outcome (win, loss, open) within ``horizon`` bars, and what was known at the entry.

    bars: prepared() with_levels(); entries: candidates(). Entries whose window ends after the last bar go.
    """
    last = bars.groupBy("symbol").agg(F.max("i").alias("__last"))
    own = entries.join(last, "symbol").filter(F.col("i") + horizon <= F.col("__last")).select("symbol", "i", "entry", "stop", "target")
    passed = first_passage(own, bars, horizon, ["symbol", "i"]).select("symbol", "i", "outcome")
    risk, c = F.col("entry") - F.col("stop"), F.col("close")
    features = {
        "rsi": F.col("rsi"), "ma_share": c / F.col("sma20") - 1, "room_r": (F.col("resistance") - F.col("entry")) / risk, "higher_low": F.col("lows_rise"), "range_place": I.range_position(), "stop_share": risk / F.col("entry"),
        "volume_ratio": F.try_divide(F.col("volume"), F.col("vol20")), "atr_share": F.col("atr_before") / c, "swept": I.swept_low(),
    }
    known = bars.withColumn("range_place", features.pop("range_place")).withColumn("swept", features.pop("swept"))
    met = known.join(own, ["symbol", "i"]).join(passed, ["symbol", "i"])
    return met.select("symbol", "i", "outcome", "range_place", "swept", *(v.alias(k) for k, v in features.items()))
