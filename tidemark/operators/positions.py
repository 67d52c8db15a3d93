"""Exits and trades of positions, as joins and windows over the bars behind each entry.

Every entry meets the bars behind it once, in time buckets. What an exit model needs is a column of that path: the
extremes before the bar, and from them the stop as it stands, raised by trailing or by a lock. The exit of
each model is the first row that meets one of its conditions, so all models are aggregates of one pass. At last
a series takes its entries in turn, each only when the one before is closed; this chain sees entries and not bars.

Within a bar the stop as it stood before the bar goes first, then the target (or the pull-back from the peak before
the bar), then the close of a swing high, then the time limit. A partial exit happens on the first bar that reaches
its level unless the stop or the target ends the position there. Raised stops hold from the next bar on.

Each model has a time limit. A position whose limit lies beyond the last bar and that no other exit ends before is
still open: it is left out, and so are the later entries of its series, as it holds their place.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import bars_behind


@dataclass(frozen=True)
class Exit:
    """An exit model; cost is the share of the notional that each side pays."""

    name: str
    target_r: float = 4.0
    max_hold: int = 300
    cost: float = 0.0045
    trail_r: float | None = None
    trail_start_r: float = 1.0
    partial_at_r: float | None = None
    partial_share: float = 0.5
    lock_at_r: float | None = None
    lock_r: float = 0.1
    fee_buffer: float = 0.0
    trailing_target: float | None = None
    swing_high: bool = False
    delay: int = 0

    def net(self, price: Column) -> Column:
        """R of leaving at a price, costs of both sides taken off."""
        return (price - F.col("entry") - self.cost * (F.col("entry") + price)) / F.col("risk")

    def level(self, r: float) -> Column:
        return F.col("entry") + r * F.col("risk")

    def raised(self) -> list[tuple[Column, Column]]:
        """(active, level) of what may have raised the stop before the bar."""
        found = []
        if self.trail_r:
            found.append((F.col("peak") >= self.level(self.trail_start_r), F.col("peak") - self.trail_r * F.col("risk")))
        if self.lock_at_r is not None:
            lock = F.greatest(self.lock_r * F.col("risk"), self.fee_buffer * F.col("entry"))
            armed = F.greatest(self.lock_at_r * F.col("risk"), lock + 0.5 * F.col("risk"))
            found.append((F.col("peak") >= F.col("entry") + armed, F.col("entry") + lock))
        return found

    def exit(self) -> Column:
        """(j, price, label, lowest, highest) of a row of the path that ends the position, else null."""
        raised = self.raised()
        stop = F.greatest("stop", *(F.when(active, level) for active, level in raised)) if raised else F.col("stop")
        moved = F.lit(False)
        for active, _ in raised:
            moved = moved | active
        ends = [(F.col("lo") <= stop, stop, F.when(moved, "trail/be").otherwise("stop"))]
        if self.trailing_target is None:
            ends.append((F.col("hi") >= self.level(self.target_r), self.level(self.target_r), F.lit("target")))
        else:
            back = F.col("peak") * (1 - self.trailing_target)
            ends.append(((F.col("peak") > F.col("entry")) & (F.col("lo") <= back), back, F.lit("trailing_target")))
        if self.swing_high:
            ends.append((F.col("swing") & (F.col("last") > F.col("entry")), F.col("last"), F.lit("swing_high")))
        ends.append((F.col("j") >= F.col("start") + self.max_hold, F.col("last"), F.lit("timeout")))
        found = F.lit(None)
        for when, price, label in reversed(ends):
            found = F.when(when, F.struct("j", price.alias("price"), label.alias("label"), "lowest", "highest")).otherwise(found)
        return found


def _started(entries: DataFrame, bars: DataFrame, delay: int) -> DataFrame:
    """entries with start, entry and risk; a delayed one begins at the open some bars on, if that is above its stop."""
    if not delay:
        return entries.withColumns({"start": F.col("i"), "risk": F.col("entry") - F.col("stop"), "low_there": F.lit(None).cast("double"), "high_there": F.lit(None).cast("double")})
    there = bars.select("symbol", (F.col("i") - delay).alias("i"), F.col("open").alias("there"), F.col("low").alias("low_there"), F.col("high").alias("high_there"))
    met = entries.join(there, ["symbol", "i"]).filter("there > stop")
    return met.withColumns({"start": F.col("i") + delay, "entry": F.col("there"), "risk": F.col("there") - F.col("stop")}).drop("there")


def every_exit(bars: DataFrame, entries: DataFrame, exits: list[Exit], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per entry and model: by, i, config, entry, risk, exit_i, exit_price, label, mae, mfe, r, partial_r; exit_i is null while open.

    bars: symbol, i, open, high, low, close, pivot; entries: by, i, entry, stop.
    """
    out = None
    for delay in sorted({x.delay for x in exits}):
        models = [x for x in exits if x.delay == delay]
        key = [*by, "i"]
        begun = _started(entries.select(*key, "entry", "stop"), bars, delay)
        path = bars.select("symbol", F.col("i").alias("j"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("close").alias("last"), F.coalesce(F.col("pivot") == "high", F.lit(False)).alias("swing"))
        met = bars_behind(begun, path, max(x.max_hold for x in models), at="start")
        upto = Window.partitionBy(*key).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*key).orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
        met = met.withColumns({"lowest": F.min("lo").over(upto), "highest": F.max("hi").over(upto), "peak": F.greatest("entry", F.max("hi").over(before))})
        ends = [F.min(x.exit()).alias(f"x{k}") for k, x in enumerate(models)]
        parts = [F.min(F.when(F.col("hi") >= x.level(x.partial_at_r), F.col("j"))).alias(f"p{k}") for k, x in enumerate(models) if x.partial_at_r]
        found = begun.join(met.groupBy(*key).agg(*ends, *parts), key, "left")
        rows = found.select(*key, "entry", "stop", "risk", "start", "low_there", "high_there", F.explode(F.array(*(_trade(x, k) for k, x in enumerate(models)))).alias("t"))
        part = rows.select(*key, "entry", "risk", "t.*")
        out = part if out is None else out.unionByName(part)
    return out


def _trade(x: Exit, k: int) -> Column:
    end, risk, entry = F.col(f"x{k}"), F.col("risk"), F.col("entry")
    net = x.net(end["price"])
    partial = F.lit(0.0)
    if x.partial_at_r:
        at = F.col(f"p{k}")
        taken = (at < end["j"]) | ((at == end["j"]) & end["label"].isin("swing_high", "timeout"))
        partial = F.when(taken, x.partial_share * x.net(x.level(x.partial_at_r))).otherwise(F.lit(0.0))
        net = F.when(taken, partial + (1 - x.partial_share) * net).otherwise(net)
    mae, mfe = F.greatest(F.lit(0.0), (entry - end["lowest"]) / risk), F.greatest(F.lit(0.0), (end["highest"] - entry) / risk)
    usual = F.struct(F.lit(x.name).alias("config"), end["j"].alias("exit_i"), end["price"].alias("exit_price"), end["label"].alias("label"), net.alias("r"), mae.alias("mae"), mfe.alias("mfe"), partial.alias("partial_r"))
    # stopped on the bar that fills
    lost = F.struct(
        F.lit(x.name).alias("config"), F.col("start").alias("exit_i"), F.col("stop").alias("exit_price"), F.lit("same_bar").alias("label"), x.net(F.col("stop")).alias("r"),
        F.greatest(F.lit(0.0), (entry - F.col("low_there")) / risk).alias("mae"), F.greatest(F.lit(0.0), (F.col("high_there") - entry) / risk).alias("mfe"), F.lit(0.0).alias("partial_r"),
    )
    return F.when(F.col("low_there") <= F.col("stop"), lost).otherwise(usual)


def simulate(bars: DataFrame, entries: DataFrame, exits: list[Exit], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The closed trades of each series and model, with trade numbered from 1 in a series.

    by: the columns that make a series of entries; symbol is one of them.
    """
    found = every_exit(bars, entries, exits, by)

    def chain(table: pa.Table) -> pa.Table:
        """Entries in turn, each at or after the bar from which the series is free."""
        table = table.sort_by("i")
        free, taken = -1, []
        for k, (i, end, same_bar) in enumerate(zip(table["i"].to_pylist(), table["exit_i"].to_pylist(), pc.equal(table["label"], "same_bar").to_pylist(), strict=True)):
            if i < free:
                continue
            if end is None:
                break
            taken.append(k)
            free = i + 1 if same_bar else end + 1
        return table.take(pa.array(taken, pa.int64())).append_column("trade", pa.array(range(1, len(taken) + 1), pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", trade bigint"
    return found.groupBy(*by, "config").applyInArrow(chain, schema).withColumnRenamed("i", "entry_i")


def summarize(trades: DataFrame, *by: str) -> DataFrame:
    """Trades, mean and total R, win rate, assets that gain, share of time-outs, R of partial exits and the rest."""
    per = trades.groupBy(*by, "symbol").agg(F.count("*").alias("n"), F.sum("r").alias("total"), F.count_if(F.col("r") > 0).alias("wins"), F.count_if(F.col("label") == "timeout").alias("timeouts"), F.sum("partial_r").alias("partial"))
    return per.groupBy(*by).agg(
        F.sum("n").alias("trades"), (F.sum("total") / F.sum("n")).alias("avg_r"), F.sum("total").alias("total_r"), (F.sum("wins") / F.sum("n")).alias("win_rate"), F.count_if(F.col("total") > 0).alias("positive_assets"),
        (F.sum("timeouts") / F.sum("n")).alias("timeout_rate"), F.sum("partial").alias("partial_r"), (F.sum("total") - F.sum("partial")).alias("runner_r"),
    )
