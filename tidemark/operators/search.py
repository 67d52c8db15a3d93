"""Searches over entry rules and exits in two stages: chosen on earlier bars, judged on later ones, which nothing else may read.

What passed the first stage is a small table; the later entries are stored by mode and joined with it, so only the folders
of chosen modes are read, and only chosen configurations get trades.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import entries as E
from tidemark.operators import positions as X
from tidemark.sources.tables import settled, shared_folder


def configurations(targets: tuple[float, ...] = (2.0, 3.0, 4.0, 5.0)) -> list[X.Exit]:
    """Targets, with and without a lock of the entry price, with and without a trailing stop of one risk."""
    return [
        X.Exit(f"target{t:g}{'-lock' if lock else ''}{'-trail' if trail else ''}", target_r=t, lock_at_r=1.0 if lock else None, lock_r=0.0, trail_r=1.0 if trail else None)
        for t in targets for lock in (False, True) for trail in (False, True)
    ]


def halves(bars: DataFrame, cut: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Each symbol's bars before and from the time of its bar at a share ``cut`` of its bars."""
    whole, order = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("time")
    at = bars.select("symbol", "time", F.row_number().over(order).alias("i"), F.count("*").over(whole).alias("n")).filter(F.col("i") - 1 == F.floor(F.col("n") * cut)).select("symbol", F.col("time").alias("__cut"))
    marked = bars.join(at, "symbol", "left")
    later = F.col("time") >= F.col("__cut")
    return marked.filter(F.coalesce(~later, F.lit(True))).drop("__cut"), marked.filter(later).drop("__cut")


def scored(trades: DataFrame, *by: str) -> DataFrame:
    """by, trades, avg_r, total_r, assets, positive_assets."""
    per = trades.groupBy(*by, "symbol").agg(F.count("*").alias("n"), F.sum("r").alias("total"))
    return per.groupBy(*by).agg(F.sum("n").alias("trades"), (F.sum("total") / F.sum("n")).alias("avg_r"), F.sum("total").alias("total_r"), F.count("*").alias("assets"), F.count_if(F.col("total") > 0).alias("positive_assets"))


def ready(bars: DataFrame) -> DataFrame:
    """Bars with all that the entry rules need, written once."""
    return settled(E.with_contraction(E.with_levels(settled(E.prepared(bars), "prepared"))), "ready")


def strategy_search(bars: DataFrame, modes: tuple[str, ...] = E.MODES, exits: list[X.Exit] | None = None, cut: float = 0.7, least: int = 100, top: int = 12) -> DataFrame:
    """mode, config, place, and of both parts trades, avg_r, assets, positive_assets, with promoted: the ``top`` configurations by mean R of the earlier part.

    least: trades that a configuration needs there; equal means, to nine places, go by name. Promoted is what gains in both parts, in the later one in half of the assets at least.
    """
    exits = exits or configurations()
    spark = bars.sparkSession
    train, holdout = (ready(x) for x in halves(bars, cut))
    series = ("symbol", "mode")
    first = settled(scored(X.simulate(train, E.every_candidate(train, modes, min_stop=None), exits, series), "mode", "config"), "train")
    chosen = first.filter(F.col("trades") >= least).withColumn("place", F.row_number().over(Window.orderBy(F.round("avg_r", 9).desc(), "mode", "config")))  # a row for each configuration
    chosen = settled(chosen.filter(F.col("place") <= top), "chosen")
    folder = shared_folder(spark, f"entries-{uuid.uuid4().hex}")
    E.every_candidate(holdout, modes, min_stop=None).write.partitionBy("mode").parquet(folder)
    asked = entries_of(spark.read.schema("symbol string, i long, time long, entry double, stop double, target double, reason string, mode string").parquet(folder), chosen, top)
    later = X.simulate(holdout, asked, exits, series).join(chosen.select("mode", "config"), ["mode", "config"], "left_semi")
    names = ["trades", "avg_r", "assets", "positive_assets"]
    second = scored(later, "mode", "config").select("mode", "config", *(F.col(c).alias(f"holdout_{c}") for c in names))
    met = chosen.select("mode", "config", "place", *names).join(second, ["mode", "config"], "left")
    good = (F.col("avg_r") > 0) & (F.col("holdout_avg_r") > 0) & (F.col("holdout_positive_assets") >= 0.5 * F.col("holdout_assets"))
    return met.withColumn("promoted", F.coalesce(good, F.lit(False)))


def entries_of(stored: DataFrame, chosen: DataFrame, top: int) -> DataFrame:
    """The stored entries (by mode) of the chosen modes; the folders of others are pruned when the query runs."""
    return stored.join(chosen.filter(F.col("place") <= top).select("mode").distinct(), "mode", "left_semi")


def passes(avg_r: float, trades: int, share: float | None = None, prefix: str = "") -> Column:
    """Whether a summary's means, number of trades and share of gaining assets are above the gate."""
    found = (F.col(f"{prefix}avg_r") > avg_r) & (F.col(f"{prefix}trades") >= trades)
    if share is not None:
        found = found & (F.col(f"{prefix}positive_assets") >= share * F.greatest(F.col(f"{prefix}assets"), F.lit(1)))
    return F.coalesce(found, F.lit(False))


def gated(train: DataFrame, holdout: Callable[[DataFrame], DataFrame], variant: str, train_gate: tuple[float, int] = (-0.5, 200), holdout_gate: tuple[float, int, float] = (-0.3, 150, 0.4), best_only: bool = False) -> DataFrame:
    """variant, the summaries of both parts, and verdict: train_fail, not_selected, holdout_fail or pass.

    train: scored() by variant. holdout: gives the scored() later part of the variants of a table, and is asked only for those that passed; with
    ``best_only`` for the best of them alone. A gate is set before the test and never moves.
    """
    first = settled(train.withColumn("passed", passes(*train_gate)), "gate")
    order = Window.partitionBy("passed").orderBy(F.col("avg_r").desc(), variant)
    ranked = first.withColumn("place", F.row_number().over(order))
    open_for = settled(ranked.filter(F.col("passed") & ((F.col("place") == 1) | F.lit(not best_only))).select(variant), "open")
    names = ["trades", "avg_r", "assets", "positive_assets"]
    second = holdout(open_for).join(open_for, variant, "left_semi").select(variant, *(F.col(c).alias(f"holdout_{c}") for c in names))
    met = first.select(variant, *names, "passed").join(open_for.withColumn("asked", F.lit(True)), variant, "left").join(second, variant, "left")
    verdict = F.when(~F.col("passed"), "train_fail").when(F.col("asked").isNull(), "not_selected").when(passes(*holdout_gate, prefix="holdout_"), "pass").otherwise("holdout_fail")
    return met.withColumn("verdict", verdict).drop("passed", "asked")
