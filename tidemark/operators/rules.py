"""Allocation rules over a panel of prices, the run of a rebalanced portfolio and its figures.

Prices are rows (d, asset, close), d the number of the date. A score looks back a number of dates, not of rows: a price
that is missing there gives no score. Weights of all rules are one table, so all runs are one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG_RULES = ("momentum", "momentum_vol", "trend_momentum", "regime_momentum", "strong_regime_momentum", "regime_long_short", "cash_gate", "breadth_cash_gate", "reversal")
SHORT_RULES = ("bear_short", "regime_long_short")
RULES = ("equal_weight", *dict.fromkeys(LONG_RULES + SHORT_RULES))


def scored(prices: DataFrame, lead: str, look: int = 30, short: int = 7, long: int = 200) -> DataFrame:
    """prices with up (return over ``look`` dates), up_short, vol (deviation of the last ``look`` one-date returns), mean (of ``long`` dates),
    the same of the lead asset (lead_*), and breadth: the share of assets that have fallen."""
    own = Window.partitionBy("asset").orderBy("d")
    at = lambda n: F.first("close").over(own.rangeBetween(-n, -n))
    base = prices.withColumns({"up": F.col("close") / at(look) - 1, "up_short": F.col("close") / at(short) - 1, "one": F.col("close") / at(1) - 1, "mean": F.avg("close").over(own.rangeBetween(1 - long, 0))})
    base = base.withColumn("vol", F.stddev_pop("one").over(own.rangeBetween(1 - look, 0))).drop("one")
    first = base.filter(F.col("asset") == lead).select("d", *(F.col(c).alias(f"lead_{c}") for c in ("close", "mean", "up", "up_short")))
    breadth = base.groupBy("d").agg((F.count_if(F.col("up") < 0) / F.nullif(F.count("up"), F.lit(0))).alias("breadth"))
    return base.join(first, "d", "left").join(breadth, "d")


def _rule(name: str) -> tuple[Column, Column]:
    """(score, open) of a long rule: the best scores are held while the rule is open."""
    above, below = F.col("lead_close") > F.col("lead_mean"), F.col("lead_close") < F.col("lead_mean")
    yes, up, known_true = F.lit(True), F.col("up"), lambda c: F.coalesce(c, F.lit(False))
    known = {
        "momentum": (up, yes),
        "momentum_vol": (F.when(F.col("vol") > 0, up), yes),
        "trend_momentum": (F.when(F.col("close") > F.col("mean"), up), yes),
        "regime_momentum": (up, known_true(above)),
        "strong_regime_momentum": (up, known_true(F.col("lead_close") > 1.05 * F.col("lead_mean"))),
        "regime_long_short": (up, known_true(above)),
        "cash_gate": (up, ~known_true(below & (F.col("lead_up") < 0))),
        "breadth_cash_gate": (up, ~known_true(below & (F.col("lead_up_short") < 0) & (F.col("breadth") >= 0.7))),
        "reversal": (-F.col("up_short"), yes),
    }
    return known[name]


def weights(panel: DataFrame, top: int = 5) -> DataFrame:
    """(rule, d, asset, w) of all rules on the dates of scored(); a rule without a row on a date holds cash.

    Long rules hold the ``top`` best scores alike (momentum_vol by inverse deviation); the short rules hold the
    weakest at less than nothing while the lead is below its mean (regime_long_short: not above it). Ties go by asset.
    """
    known_true = lambda c: F.coalesce(c, F.lit(False))
    longs = F.array(*(F.struct(F.lit(n).alias("rule"), _rule(n)[0].alias("score"), (F.try_divide(F.lit(1.0), F.col("vol")) if n == "momentum_vol" else F.lit(1.0)).alias("size"), F.when(_rule(n)[1], 1.0).alias("sign")) for n in LONG_RULES))
    below, above = F.col("lead_close") < F.col("lead_mean"), F.col("lead_close") > F.col("lead_mean")
    shorts = F.array(*(F.struct(F.lit(n).alias("rule"), (-F.col("up")).alias("score"), F.lit(1.0).alias("size"), F.when(gate, -1.0).alias("sign")) for n, gate in (("bear_short", known_true(below)), ("regime_long_short", ~known_true(above)))))
    rows = panel.select("d", "asset", F.explode(F.concat(longs, shorts)).alias("x")).select("d", "asset", "x.*").filter("score is not null and sign is not null")
    place = F.row_number().over(Window.partitionBy("rule", "d", "sign").orderBy(F.col("score").desc(), "asset"))
    chosen = rows.withColumn("place", place).filter(F.col("place") <= top)
    held = chosen.select("rule", "d", "asset", (F.col("sign") * F.col("size") / F.sum("size").over(Window.partitionBy("rule", "d"))).alias("w"))
    universe = panel.select("asset").distinct()
    equal = panel.select("d").distinct().crossJoin(F.broadcast(universe)).crossJoin(F.broadcast(universe.agg(F.count("*").alias("n"))))
    return held.unionByName(equal.select(F.lit("equal_weight").alias("rule"), "d", "asset", (1 / F.col("n")).alias("w")))


def portfolio_runs(prices: DataFrame, held: DataFrame, start: int, every: int) -> DataFrame:
    """(rule, d, ret, turnover): the weights of every n-th date from ``start`` on earn from their date's close on.

    A date's return is over the assets with prices on it and on the next date; 0 where their weights do not add up to more
    than nothing. Turnover is half of what changes hands, on dates of rebalancing.
    """
    dates = prices.agg(F.max("d").alias("end"))
    rules = held.select("rule").distinct()
    calendar = dates.filter(F.col("end") > start).select(F.explode(F.sequence(F.lit(start).cast("long"), F.col("end").cast("long") - 1)).alias("d"))
    grid = calendar.crossJoin(F.broadcast(rules)).withColumn("reb", F.floor((F.col("d") - start) / every))
    chosen = held.filter((F.col("d") >= start) & ((F.col("d") - start) % every == 0)).withColumn("reb", F.floor((F.col("d") - start) / every)).select("rule", "reb", "asset", "w")
    after = F.first("close").over(Window.partitionBy("asset").orderBy("d").rangeBetween(1, 1))
    moves = prices.select("d", "asset", (after / F.col("close") - 1).alias("r")).filter((F.col("d") >= start) & F.col("r").isNotNull()).withColumn("reb", F.floor((F.col("d") - start) / every))
    earned = moves.join(chosen, ["reb", "asset"]).groupBy("rule", "d").agg(F.sum("w").alias("active"), F.sum(F.col("w") * F.col("r")).alias("sum"))
    last = chosen.select("rule", (F.col("reb") + 1).alias("reb"), "asset", F.col("w").alias("w0"))
    traded = chosen.join(last, ["rule", "reb", "asset"], "full").groupBy("rule", "reb").agg((F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))) / 2).alias("turnover"))
    met = grid.join(earned, ["rule", "d"], "left").join(traded, ["rule", "reb"], "left")
    ret = F.coalesce(F.when(F.col("active") > 1e-12, F.col("sum") / F.col("active")), F.lit(0.0))
    changed = F.when((F.col("d") - start) % every == 0, F.coalesce("turnover", F.lit(0.0))).otherwise(0.0)
    return met.select("rule", "d", ret.alias("ret"), changed.alias("turnover"))


def figures(runs: DataFrame, cost: float, periods: int = 365) -> DataFrame:
    """Per rule of portfolio_runs(): dates, total, annual, volatility, sharpe, drawdown (of the equity after each date), turnover, average."""
    order = Window.partitionBy("rule").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    grown = runs.withColumn("equity", F.exp(F.sum(F.log((1 - F.col("turnover") * cost) * (1 + F.col("ret")))).over(order)))
    lows = grown.withColumn("fall", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(order)) - 1)
    sums = lows.groupBy("rule").agg(F.count("*").alias("dates"), (F.max_by("equity", "d") - 1).alias("total"), (F.stddev_pop("ret") * periods**0.5).alias("volatility"), F.least(F.lit(0.0), F.min("fall")).alias("drawdown"), F.sum("turnover").alias("turnover"), F.avg("ret").alias("average"))
    annual = sums.withColumn("annual", F.pow(1 + F.col("total"), F.lit(float(periods)) / F.col("dates")) - 1)
    return annual.withColumn("sharpe", F.when(F.col("volatility") > 0, F.col("annual") / F.col("volatility")).otherwise(0.0))
