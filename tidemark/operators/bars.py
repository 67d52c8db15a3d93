"""Bars from trades, coarser bars, and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import by_time, ratio


def aggregate_trades(trades: DataFrame, seconds: int = 60) -> DataFrame:
    """Bars of the trades (symbol, seq, sec, price, volume, side); first and last by arrival (seq)."""
    side = lambda is_buy: F.sum(F.when((F.col("side") == "b") == is_buy, F.col("volume")).otherwise(0.0))
    return trades.groupBy("symbol", (F.floor(F.col("sec") / seconds) * seconds).cast("long").alias("time")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"),
        side(True).alias("buy_vol"), side(False).alias("sell_vol"), F.count("*").alias("trades"), F.max("volume").alias("max_trade"),
    )


def resample(bars: DataFrame, minutes: int, now: int | None = None) -> DataFrame:
    """Bars aligned to the epoch, order flow included; with ``now``, unfinished buckets are left out."""
    span = minutes * 60
    found = bars.groupBy("symbol", (F.floor(F.col("time") / span) * span).cast("long").alias("bucket")).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"),
        F.sum("buy_vol").alias("buy_vol"), F.sum("sell_vol").alias("sell_vol"), F.sum("trades").alias("trades"), F.max("max_trade").alias("max_trade"),
    )
    found = found.withColumnRenamed("bucket", "time")
    return found if now is None else found.filter(F.col("time") + span <= now)


def gaps(bars: DataFrame, seconds: int = 60) -> DataFrame:
    """symbol, from, to, seconds: consecutive bars further apart than the interval."""
    return (
        bars.select("symbol", F.lag("time").over(by_time()).alias("from"), F.col("time").alias("to"))
        .withColumn("seconds", F.col("to") - F.col("from") - seconds)
        .filter("seconds > 0")
    )


def invalid(seconds: int = 60, signed: bool = False) -> Column:
    """Whether a bar breaks a rule: ten finite fields, whole minutes from 1970 on, positive prices, high and low around the others, nothing negative.

    signed: the bars are of a level that may be zero or less (a spread, a walk), so its sign is no fault; all other rules hold.
    """
    prices, amounts = ([F.col(c) for c in names] for names in (("open", "high", "low", "close"), ("volume", "buy_vol", "sell_vol", "max_trade", "trades")))
    bad = F.col("time").isNull() | (F.col("time") % seconds != 0) | (F.col("time") < 0)
    for c in [*prices, *amounts]:
        bad = bad | c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    for c in [] if signed else prices:
        bad = bad | (c <= 0)
    for c in amounts:
        bad = bad | (c < 0)
    return F.coalesce(bad | (F.col("high") < F.greatest(*prices)) | (F.col("low") > F.least(*prices)), F.lit(True))


def quality(bars: DataFrame, seconds: int, signed: bool = False) -> DataFrame:
    """Per symbol: bars, invalid ones (of prices, or of levels of any sign), span, gaps wider than the interval and the widest distance."""
    step = bars.withColumn("step", F.col("time") - F.lag("time").over(by_time())).withColumn("bad", invalid(signed=signed))
    return step.groupBy("symbol").agg(
        F.count("*").alias("total"), F.count_if("bad").alias("invalid"), F.min("time").alias("start"), F.max("time").alias("end"),
        F.count_if(F.col("step") > seconds).alias("gaps"), F.coalesce(F.max(F.when(F.col("step") > seconds, F.col("step"))), F.lit(0)).alias("largest_gap"),
    )


def gap_audit(bars: DataFrame, seconds: int, now: int | None = None, train: float = 0.7, much: float = 0.01, old: float = 14.0) -> DataFrame:
    """Per symbol: missing share of its window, gaps and missing seconds before and after the cut at ``train`` of its bars (by the middle of the gap), days since the last bar ended.

    flagged: more than the share ``much`` is missing; stale: the last bar ended more than ``old`` days before ``now``, the end of the last bar of all by default.
    """
    n = Window.partitionBy("symbol")
    cut = bars.withColumns({"i": F.row_number().over(by_time()) - 1, "n": F.count("*").over(n)}).filter(F.col("i") == F.floor(F.col("n") * train)).select("symbol", F.col("time").alias("cut"))
    span = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("time").alias("start"), F.max("time").alias("end"))
    if now is None:
        now = (bars.agg(F.max("time")).first()[0] or 0) + seconds
    found = span.join(cut, "symbol", "left").join(gaps(bars, seconds), "symbol", "left").withColumn("early", (F.col("from") + F.col("to")) / 2 < F.col("cut"))
    missing = lambda when: F.coalesce(F.sum(F.when(when, F.col("seconds"))), F.lit(0))
    audited = found.groupBy("symbol", "bars", "start", "end").agg(
        F.count("seconds").alias("gaps"), missing(F.lit(True)).alias("missing"), F.coalesce(F.max("seconds"), F.lit(0)).alias("largest"), F.count_if("early").alias("train_gaps"), F.count_if(~F.col("early")).alias("holdout_gaps"),
        missing(F.col("early")).alias("train_missing"), missing(~F.col("early")).alias("holdout_missing"),
    )
    share, days = F.col("missing") / (F.col("end") - F.col("start") + seconds), F.greatest(F.lit(0), F.lit(now) - F.col("end") - seconds) / 86400
    return audited.withColumns({"missing_share": share, "flagged": share > much, "stale_days": days, "stale": days > old}).drop("start", "end")


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: the greatest by its other columns, in the order of their names, so repeated tasks give the same."""
    others = sorted(c for c in rows.columns if c not in keys)
    first = rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row"))
    return first.select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in rows.columns))


def merge(stored: DataFrame, archive: DataFrame) -> DataFrame:
    """Bars of both; where both have a minute, the archive's. Of repeated bars of one side the same one stays whenever it is run."""
    both = stored.withColumn("!rank", F.lit(0)).unionByName(archive.withColumn("!rank", F.lit(1)))  # the first name in order
    return one_of_each(both, ["symbol", "time"]).drop("!rank")


def replace_range(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """The rebuilt minutes, one bar each, replace the stored ones; the other stored minutes stay."""
    return stored.join(rebuilt, ["symbol", "time"], "left_anti").unionByName(one_of_each(rebuilt, ["symbol", "time"]))


def deviation(stored: DataFrame, other: DataFrame, signed: bool = False) -> DataFrame:
    """Per symbol: matching minutes and the largest relative deviations of close and volume; of closes of any sign, if signed, else of positive ones."""
    met = stored.select("symbol", "time", "close", "volume").join(other.select("symbol", "time", F.col("close").alias("c"), F.col("volume").alias("v")), ["symbol", "time"])
    off = lambda a, b: F.max(F.when(F.col(b) > 0, F.abs(F.col(a) - F.col(b)) / F.col(b)))
    closes = F.max(ratio(F.abs(F.col("close") - F.col("c")), F.col("c"))) if signed else off("close", "c")
    return met.groupBy("symbol").agg(F.count("*").alias("matched"), closes.alias("close_off"), off("volume", "v").alias("volume_off"))
