"""Joins on time: as-of by a union and a running last value, first passage and touches by bounded ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(queries: DataFrame, values: DataFrame, value: str, key: str = "symbol", at: str = "time", default: Column | None = None, lag: int = 0) -> DataFrame:
    """queries with the last value known at their time (inclusive), ``lag`` seconds after its own time.

    Both sides are united and read in order of time, values first, so a key needs one shuffle and no
    comparison of every query with every value.
    """
    columns = queries.columns
    left = queries.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__query"), F.struct(*columns).alias("__row"), F.lit(None).cast(values.schema[value].dataType).alias("__value"))
    right = values.select(F.col(key).alias("__key"), (F.col(at) + lag).alias("__at"), F.lit(0).alias("__query"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"))
    order = Window.partitionBy("__key").orderBy("__at", "__query").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("__last", F.last("__value", ignorenulls=True).over(order)).filter("__query = 1")
    last = F.col("__last") if default is None else F.coalesce("__last", default)
    return found.select("__row.*", last.alias(value if value not in columns else f"{value}_as_of"))


def numbered(bars: DataFrame) -> DataFrame:
    """bars with i, the place in its series from 0."""
    return bars.withColumn("i", (F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1).cast("long"))


def bars_behind(entries: DataFrame, path: DataFrame, horizon: int, at: str = "i") -> DataFrame:
    """entries with each of the ``horizon`` bars of their symbol behind bar ``at``: the columns of path, whose bar is j.

    Time is cut into buckets of ``horizon`` bars; an entry is sent to the two that its bars lie in, so a task meets
    entries and bars of one stretch of a series and never a whole series with itself.
    """
    bucket = lambda x: F.floor(x / horizon)
    asked = entries.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(F.col(at) + 1), bucket(F.col(at) + horizon)))))
    keyed = path.withColumn("__bucket", bucket(F.col("j")))
    return asked.join(keyed, ["symbol", "__bucket"]).filter((F.col("j") > F.col(at)) & (F.col("j") <= F.col(at) + horizon)).drop("__bucket")


def first_passage(entries: DataFrame, bars: DataFrame, horizon: int, by: list[str]) -> DataFrame:
    """entries (symbol, i, stop, target, and what by names) with stop_at, target_at and outcome.

    The first of the ``horizon`` bars after i that reaches the stop or the target; a bar that
    reaches both counts as the stop. outcome: loss, win or open.
    """
    path = bars.select("symbol", F.col("i").alias("j"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    met = bars_behind(entries, path, horizon)
    reached = met.groupBy(*by).agg(F.min(F.when(F.col("lo") <= F.col("stop"), F.col("j"))).alias("stop_at"), F.min(F.when(F.col("hi") >= F.col("target"), F.col("j"))).alias("target_at"))
    found = entries.select(*by).distinct().join(reached, by, "left")  # an entry on the last bar has none behind it
    loss = F.col("stop_at").isNotNull() & (F.col("target_at").isNull() | (F.col("stop_at") <= F.col("target_at")))
    return found.withColumn("outcome", F.when(loss, "loss").when(F.col("target_at").isNotNull(), "win").otherwise("open"))


def first_passages(entries: DataFrame, bars: DataFrame, horizon: int, stops: list[float], targets: list[float]) -> DataFrame:
    """(k_stop, k_target, n, wins, losses, open) of every pair of stop and target, in units of the entry's ``unit``.

    entries: (symbol, i, close, unit). Each level's first bar is found once in one range join, then the
    pairs are compared; a bar that reaches both counts as the stop. An entry counts only if the ``horizon`` bars
    after it are all there.
    """
    last = bars.groupBy("symbol").agg(F.max("i").alias("last"))
    whole = entries.join(last, "symbol").filter(F.col("i") + horizon <= F.col("last")).drop("last")
    met = bars_behind(whole, bars.select("symbol", F.col("i").alias("j"), F.col("low").alias("lo"), F.col("high").alias("hi")), horizon)
    first = lambda reached: F.min(F.when(reached, F.col("j")))
    found = met.groupBy("symbol", "i").agg(
        *(first(F.col("lo") <= F.col("close") - k * F.col("unit")).alias(f"s{a}") for a, k in enumerate(stops)),
        *(first(F.col("hi") >= F.col("close") + m * F.col("unit")).alias(f"t{b}") for b, m in enumerate(targets)),
    )
    pairs = F.array(*(F.struct(F.lit(k).alias("k_stop"), F.lit(m).alias("k_target"), F.col(f"s{a}").alias("sa"), F.col(f"t{b}").alias("ta")) for a, k in enumerate(stops) for b, m in enumerate(targets)))
    win = F.col("ta").isNotNull() & (F.col("sa").isNull() | (F.col("ta") < F.col("sa")))
    loss = F.col("sa").isNotNull() & ~win
    cells = found.select(F.explode(pairs).alias("g")).select("g.*")
    return cells.groupBy("k_stop", "k_target").agg(F.count("*").alias("n"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"), F.count_if(~win & ~loss).alias("open"))


def in_every_series(bars: DataFrame) -> DataFrame:
    """The times that all symbols have."""
    symbols = bars.agg(F.count_distinct("symbol").alias("all"))
    return bars.groupBy("time").agg(F.count_distinct("symbol").alias("n")).join(F.broadcast(symbols), F.col("n") == F.col("all")).select("time")


def reconcile(held: DataFrame, tracked: DataFrame, dust: float, part: float = 0.5) -> DataFrame:
    """symbol, kind: orphans are held and not tracked (worth ``dust`` or more), ghosts tracked and held to less than ``part``.

    held: symbol, qty, value; tracked: symbol, volume.
    """
    both = held.join(tracked, "symbol", "full_outer")
    orphan = F.col("volume").isNull() & (F.col("value") >= dust)
    ghost = F.col("volume").isNotNull() & (F.coalesce("qty", F.lit(0.0)) < part * F.col("volume"))
    return both.select("symbol", F.when(orphan, "orphan").when(ghost, "ghost").alias("kind")).filter("kind is not null")
