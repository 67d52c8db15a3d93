"""Ways to part histories in time, or by symbol, before anything is chosen on them.

Where a series has bars of several intervals, cuts are places among the bars of one of them, the anchor, and hold for the others by time.
A cut is a row per symbol (and fold), so parting is a join by symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(anchor: DataFrame) -> DataFrame:
    """symbol, time, i, n: each bar's place in its symbol, from 0, and the number of bars."""
    return anchor.select("symbol", "time", (F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1).alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))


def walk_forward(anchor: DataFrame, folds: int = 4, train: float = 0.5) -> DataFrame:
    """symbol, fold, train_until, holdout_until: each fold trains on all bars up to a time and is judged on those behind it up to another.

    The first fold trains on a share ``train`` of the bars, the rest is dealt evenly to the folds; the last one takes what is over. A fold without bars on
    either side is left out.
    """
    first = F.floor(F.col("n") * train)
    step = F.floor((F.col("n") - first) / folds)
    counts = anchor.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    cuts = counts.select("symbol", "fold", (first + (F.col("fold") - 1) * step).alias("cut"), F.when(F.col("fold") == folds, F.col("n")).otherwise(first + F.col("fold") * step).alias("end")).filter("cut > 0 and cut < end")
    at = _placed(anchor).select("symbol", "time", "i")
    until = lambda place, name: at.select("symbol", (F.col("i") + 1).alias(place), F.col("time").alias(name))
    return cuts.join(until("cut", "train_until"), ["symbol", "cut"]).join(until("end", "holdout_until"), ["symbol", "end"]).select("symbol", "fold", "train_until", "holdout_until")


def in_folds(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows with fold and part (train or holdout), once for each fold that has them."""
    met = rows.join(windows, "symbol").filter(F.col("time") <= F.col("holdout_until"))
    return met.withColumn("part", F.when(F.col("time") <= F.col("train_until"), "train").otherwise("holdout")).drop("train_until", "holdout_until")


def epochs(anchor: DataFrame, k: int) -> DataFrame:
    """symbol, epoch (from 0), begin, end (null for the last): parts of equal counts of the anchor's bars, half open."""
    counts = anchor.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    at = _placed(anchor).select("symbol", "i", F.col("time").alias("begin"))
    begun = counts.withColumn("i", F.floor(F.col("n") * F.col("epoch") / k)).join(at, ["symbol", "i"])
    return begun.select("symbol", "epoch", "begin", F.lead("begin").over(Window.partitionBy("symbol").orderBy("epoch")).alias("end"))


def in_epochs(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """rows with their epoch; those before the first one go."""
    met = rows.join(bounds, "symbol").filter((F.col("time") >= F.col("begin")) & (F.col("end").isNull() | (F.col("time") < F.col("end"))))
    return met.drop("begin", "end")


def _part(later: Column) -> Column:
    return F.when(later, "holdout").otherwise("train")


def by_fraction(rows: DataFrame, anchor: DataFrame, share: float = 0.7) -> DataFrame:
    """rows with part: each symbol is cut at the time of the anchor's bar at a share of its bars; without such a bar all is training."""
    cut = _placed(anchor).filter(F.col("i") == F.floor(F.col("n") * share)).select("symbol", F.col("time").alias("__cut"))
    return rows.join(cut, "symbol", "left").withColumn("part", _part(F.coalesce(F.col("time") >= F.col("__cut"), F.lit(False)))).drop("__cut")


def by_time(rows: DataFrame, cut: int) -> DataFrame:
    """rows with part, cut at one time for all symbols."""
    return rows.withColumn("part", _part(F.col("time") >= cut))


def by_recent_days(rows: DataFrame, days: int) -> DataFrame:
    """rows with part: held out is what is at most so many days older than the latest row of all."""
    latest = rows.agg(F.max("time").alias("__latest"))
    return rows.join(F.broadcast(latest), F.col("time") <= F.col("__latest")).withColumn("part", _part(F.col("time") >= F.col("__latest") - days * 86400)).drop("__latest")


def by_recent_dates(rows: DataFrame, dates: int, date: str = "date") -> DataFrame:
    """rows with part: held out are the last so many distinct dates."""
    held = rows.select(date).distinct().orderBy(F.col(date).desc()).limit(dates).withColumn("__held", F.lit(True))
    return rows.join(F.broadcast(held), date, "left").withColumn("part", _part(F.col("__held").isNotNull())).drop("__held")


def by_symbol(rows: DataFrame, universe: list[str], holdout: list[str], least: int = 1) -> DataFrame:
    """The rows of the universe with part: held out are whole symbols. A held-out symbol that is missing, or fewer than ``least`` others, end the query."""
    own = rows.filter(F.col("symbol").isin(universe))
    held = F.col("symbol").isin(holdout)
    found = own.agg(F.count_distinct(F.when(held, F.col("symbol"))).alias("held"), F.count_distinct(F.when(~held, F.col("symbol"))).alias("rest")).first()
    if found.held != len(set(holdout)) or found.rest < least:
        raise ValueError("the held-out symbols or enough others aren't there")
    return own.withColumn("part", _part(held))


def by_window(rows: DataFrame, anchor: DataFrame, start: int, end: int, share: float = 0.7) -> DataFrame:
    """The rows between two times, with part: cut at a share of the anchor's bars between them."""
    inside = F.col("time").between(start, end)
    return by_fraction(rows.filter(inside), anchor.filter(inside), share)
