"""Costs, position sizes and allocations. What looks sequential is windows, prefix sums and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators.indicators import ln, ratio


def running(*keys: str, order: str = "time"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def fee_tiers(rows: DataFrame, tiers: list[tuple[float, float, float]], volume: str = "volume") -> DataFrame:
    """maker and taker of the last tier (least volume, maker, taker) that the volume reaches; null below all."""
    steps = F.array(*(F.struct(F.lit(float(a)).alias("least"), F.lit(float(m)).alias("maker"), F.lit(float(t)).alias("taker")) for a, m, t in sorted(tiers)))
    found = F.array_max(F.filter(steps, lambda x: x["least"] <= F.col(volume)))
    return rows.withColumns({"maker": found["maker"], "taker": found["taker"]})


def funding_cost(positions: DataFrame, rates: DataFrame) -> DataFrame:
    """The sum of rates with entry <= time < exit, by prefix sums and two as-of joins instead of a range join.

    positions: (symbol, entry, exit, ...); rates: (symbol, time, rate).
    """
    before = rates.select("symbol", (F.col("time") + 1).alias("time"), F.sum("rate").over(running("symbol")).alias("paid"))
    own = positions.columns

    def until(df: DataFrame, at: str, name: str) -> DataFrame:
        met = J.as_of(df.withColumn("time", F.col(at)), before, "paid", default=F.lit(0.0))
        return met.withColumnRenamed("paid", name).drop("time")

    both = until(until(positions, "entry", "paid_entry"), "exit", "paid_exit")
    return both.select(*own, (F.col("paid_exit") - F.col("paid_entry")).alias("funding"))


def cost_surface(trades: DataFrame, fees: list[float], slips: list[float], *keys: str) -> DataFrame:
    """Mean net result at every fee and slip: both sums once, then the grid. trades: (entry, px, risk)."""
    sums = trades.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("px") - F.col("entry")) / F.col("risk")).alias("gross"), F.sum((F.col("px") + F.col("entry")) / F.col("risk")).alias("unit"))
    grid = F.array(*(F.struct(F.lit(f).alias("fee"), F.lit(s).alias("slip")) for f in fees for s in slips))
    return sums.withColumn("g", F.explode(grid)).select(*keys, "g.fee", "g.slip", "n", ((F.col("gross") - (F.col("g.fee") + F.col("g.slip")) * F.col("unit")) / F.col("n")).alias("net"))


def sized_equity(trades: DataFrame, start: float, cap: int, after_loss: bool = True) -> DataFrame:
    """Stakes that double after each loss in a row (or win), 2 ** cap at most, and the equity.

    trades: (symbol, time, r). A loss is r <= 0; the stake of a trade depends on those before it.
    """
    order = Window.partitionBy("symbol").orderBy("time")
    doubling = (F.col("r") <= 0) if after_loss else (F.col("r") > 0)
    flagged = trades.withColumn("d", doubling.cast("int"))
    run = flagged.withColumn("island", F.sum(1 - F.col("d")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    streak = run.withColumn("streak", F.sum("d").over(Window.partitionBy("symbol", "island").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)))
    staked = streak.withColumn("stake", F.pow(F.lit(2.0), F.least(F.coalesce(F.lag("streak").over(order), F.lit(0)), F.lit(cap))))
    return staked.withColumn("equity", F.lit(start) + F.sum(F.col("stake") * F.col("r")).over(running("symbol"))).drop("d", "island", "streak")


def fixed_interval_buys(prices: DataFrame, every: int) -> DataFrame:
    """One unit of money every n-th row: (symbol, time, close, invested, value)."""
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1
    bought = prices.withColumn("k", k).withColumn("buy", (F.col("k") % every == 0).cast("double"))
    held = bought.withColumn("units", F.sum(F.col("buy") / F.col("close")).over(running("symbol"))).withColumn("invested", F.sum("buy").over(running("symbol")))
    return held.select("symbol", "time", "close", "invested", (F.col("units") * F.col("close")).alias("value"))


def buy_and_hold(prices: DataFrame) -> DataFrame:
    """symbol, value: what one unit of money put in at the first price is worth at the last."""
    return prices.groupBy("symbol").agg((F.max_by("close", "time") / F.min_by("close", "time")).alias("value"))


def _carried(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbol, k, price: from a symbol's first date on the last known price at every date of the shared calendar; and k, time of the calendar.

    A symbol's dates are a sequence from its first one, so no symbol meets dates before it or another symbol.
    """
    dates = prices.select("time").distinct().withColumn("k", F.row_number().over(Window.orderBy("time")) - 1)  # a row for each date
    known = prices.filter("close > 0").join(dates, "time").select("symbol", "k", "close")
    last = dates.agg(F.max("k").alias("last"))
    spans = known.groupBy("symbol").agg(F.min("k").alias("first")).join(F.broadcast(last), F.col("first") <= F.col("last"))
    days = spans.select("symbol", F.explode(F.sequence("first", "last")).alias("k"))
    price = F.last("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return days.join(known, ["symbol", "k"], "left").withColumn("price", price).drop("close"), dates


def shared_interval_buys(prices: DataFrame, every: int, amount: float = 1.0, cost: float = 0.0085) -> DataFrame:
    """time, invested, value, ratio, drawdown of every date: ``amount`` on every n-th date of the shared calendar, split evenly among the symbols seen so far.

    A price that is missing is the last one known. drawdown: the ratio of value and money put in below its running peak, which begins at 1.
    """
    held, dates = _carried(prices)
    seen = Window.partitionBy("k")
    buy = F.when(F.col("k") % every == 0, amount / F.count("*").over(seen) * (1 - cost) / F.col("price")).otherwise(0.0)
    units = F.sum("buy").over(Window.partitionBy("symbol").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    worth = held.withColumn("buy", buy).withColumn("units", units).groupBy("k").agg(F.sum(F.col("units") * F.col("price")).alias("value"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # over dates
    run = dates.join(worth, "k", "left").withColumn("bought", F.when((F.col("k") % every == 0) & F.col("value").isNotNull(), amount).otherwise(0.0)).withColumn("invested", F.sum("bought").over(w))
    ratio = F.try_divide("value", F.nullif("invested", F.lit(0.0)))
    return run.withColumn("ratio", ratio).withColumn("peak", F.greatest(F.lit(1.0), F.max("ratio").over(w))).select("time", "invested", F.coalesce("value", F.lit(0.0)).alias("value"), "ratio", (F.col("ratio") / F.col("peak") - 1).alias("drawdown"))


def shared_buy_and_hold(prices: DataFrame, cost: float = 0.0085) -> DataFrame:
    """time, value, drawdown: one unit of money split evenly among the symbols priced on the first date, held with the last known prices."""
    held, dates = _carried(prices)
    first = Window.partitionBy("symbol").orderBy("k")
    own = held.withColumns({"k0": F.min("k").over(Window.partitionBy("symbol")), "p0": F.first("price").over(first)}).filter("k0 = 0")
    worth = own.groupBy("k").agg((F.sum(F.col("price") / F.col("p0")) / F.count("*") * (1 - cost)).alias("value"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    run = dates.join(worth, "k", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return run.select("time", "value", (F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(w)) - 1).alias("drawdown"))


def grid_levels(ranges: DataFrame, levels: int) -> DataFrame:
    """Geometric levels from lo to hi, one row each; flat ranges have none."""
    spread = ranges.filter("lo > 0 and hi > lo").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return spread.withColumn("level", F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.col("k") / (levels - 1)))


def rebalanced_portfolio(panel: DataFrame, every: int, top: int, cost: float) -> DataFrame:
    """Per date: ret, turnover and equity of the ``top`` assets by trail, equally weighted, chosen every n dates.

    panel: (date, asset, trail, fwd). Weights don't drift; a date's return is over the assets priced then.
    The last step is a window over one row per date.
    """
    days = panel.select("date").distinct().withColumn("d", F.row_number().over(Window.orderBy("date")) - 1)
    dated = panel.join(F.broadcast(days), "date").withColumn("reb", F.floor(F.col("d") / every))
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.col("trail").desc(), "asset"))
    chosen = dated.filter(F.col("d") % every == 0).withColumn("place", place).filter(F.col("place") <= top)
    weights = chosen.withColumn("w", F.lit(1.0) / F.count("*").over(Window.partitionBy("reb"))).select("reb", "asset", "w")
    earned = dated.join(weights, ["reb", "asset"]).groupBy("date", "d", "reb").agg((F.sum(F.col("w") * F.col("fwd")) / F.sum("w")).alias("ret"))
    last = weights.select((F.col("reb") + 1).alias("reb"), "asset", F.col("w").alias("w0"))
    change = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))
    traded = weights.join(last, ["reb", "asset"], "full").groupBy("reb").agg((F.sum(change) / 2).alias("turnover"))
    daily = earned.join(traded, "reb").withColumn("turnover", F.when(F.col("d") % every == 0, F.col("turnover")).otherwise(0.0))
    growth = F.log((1 - F.col("turnover") * cost) * (1 + F.col("ret")))
    return daily.select("date", "ret", "turnover", F.exp(F.sum(growth).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).alias("equity"))


def exposure(bars: DataFrame, state: Column, cost: float) -> DataFrame:
    """Per symbol: compound growth of holding while the state of the bar before held, and of buy and hold, with costs; no number where a level changes its sign."""
    order = Window.partitionBy("symbol").orderBy("time")
    held = bars.withColumn("s", F.coalesce(state, F.lit(False)).cast("int")).withColumns({"held": F.coalesce(F.lag("s").over(order), F.lit(0)), "ret": F.coalesce(ratio(F.col("close"), F.lag("close").over(order)) - 1, F.lit(0.0))})
    flips = F.abs(F.col("held") - F.coalesce(F.lag("held").over(order), F.lit(0)))
    steps = held.withColumn("flip", flips)
    return steps.groupBy("symbol").agg(
        F.sum("flip").alias("flips"), F.exp(F.sum(ln(1 + F.col("held") * F.col("ret")) + F.col("flip") * F.log(F.lit(1 - cost)))).alias("growth"),
        F.exp(F.sum(ln(1 + F.col("ret"))) + 2 * F.log(F.lit(1 - cost))).alias("hold"),
    )


def risk_size(cash: float, stop_share: Column, most: float = 0.2, risk: float = 0.005, multiplier: float = 1.0) -> Column:
    """Money for a position: a share of the cash, or what loses ``risk`` of it at the stop."""
    return F.least(F.lit(cash * most), F.lit(cash * risk * multiplier) / stop_share)


def post_only_rejected(side: Column, limit: Column, bid: Column, ask: Column) -> Column:
    """Whether a resting order would cross the spread on arrival."""
    return F.coalesce(F.when(side == "buy", limit >= ask).when(side == "sell", limit <= bid), F.lit(False))


def commission_floor(trades: DataFrame, sizes: list[float], per_share: float = 0.005, least: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, usd, trades, too_small, net: mean R of whole shares for so much money, each leg paying by share or the least commission.

    trades: (keys, entry, risk, r before costs).
    """
    sized = trades.withColumn("usd", F.explode(F.array(*map(F.lit, sizes)))).withColumn("shares", F.floor(F.col("usd") / F.col("entry")))
    paid = 2 * F.greatest(F.col("shares") * per_share, F.lit(least)) / (F.col("shares") * F.col("risk"))
    held = F.col("shares") >= 1
    return sized.groupBy(*keys, "usd").agg(F.count_if(held).alias("trades"), F.count_if(~held).alias("too_small"), F.avg(F.when(held, F.col("r") - paid)).alias("net"))


def open_positions(held: DataFrame, fee: float) -> DataFrame:
    """held with pnl (gross less the fees of both sides) and r at the current price. held: (entry, volume, risk, price)."""
    gross = (F.col("price") - F.col("entry")) * F.col("volume")
    return held.withColumns({"pnl": gross - (F.col("entry") + F.col("price")) * F.col("volume") * fee, "r": F.when(F.col("risk") > 0, (F.col("price") - F.col("entry")) / F.col("risk")).otherwise(0.0)})
