"""Aggregates: summaries, quantiles, ranks, correlations, corrections for many tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import indicators as I


def stat(value: str) -> list[Column]:
    """n, mean, sample deviation, standard error, bounds of the 95 % interval, share above 0, total, best."""
    x = F.col(value)
    n, mean, sd = F.count(x), F.avg(x), F.coalesce(F.stddev_samp(x), F.lit(0.0))
    se = sd / F.sqrt(n)
    return [
        n.alias("n"), mean.alias("mean"), sd.alias("sd"), se.alias("se"), (mean - 1.96 * se).alias("lo"), (mean + 1.96 * se).alias("hi"),
        F.avg((x > 0).cast("double")).alias("win_rate"), F.sum(x).alias("total"), F.coalesce(F.max(x), F.lit(0.0)).alias("best"),
    ]


#: Place (from 0) of the p-quantile among n sorted values, by definition.
PLACES = {
    "floor": lambda p, n: F.least(n - 1, F.floor(n * p)),
    "round": lambda p, n: F.greatest(F.lit(0), F.least(n - 1, F.floor(p * (n - 1) + 0.5))),
    "floor_n1": lambda p, n: F.floor((n - 1) * p),
}


def quantiles(df: DataFrame, value: str, points: list[float], place: str, by: list[str]) -> DataFrame:
    """by, p, value: quantiles that are values of the data, by row number, so no group is collected."""
    own, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    ranked = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("value"), (F.row_number().over(own) - 1).alias("at"), F.count("*").over(whole).alias("n"))
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), PLACES[place](F.lit(p), F.col("n")).cast("int").alias("k")) for p in points)))
    return ranked.select(*by, "value", "at", wanted.alias("w")).filter("at = w.k").select(*by, F.col("w.p").alias("p"), "value")


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1; ties share the mean of their ranks."""
    order, ties = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: list[str], least: int) -> DataFrame:
    """by, n, ic: rank correlation of groups with ``least`` rows or more; groups without variance go."""
    ranked = df.select(*by, average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"))
    found = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.covar_pop("rx", "ry").alias("c"))
    return found.filter((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0)).select(*by, "n", (F.col("c") / F.col("sx") / F.col("sy")).alias("ic"))


def decile_spread(df: DataFrame, rank_by: str, value: str, by: list[str]) -> DataFrame:
    """by, spread: mean of the top tenth less that of the bottom tenth (one row at least)."""
    order, whole = Window.partitionBy(*by).orderBy(rank_by, value), Window.partitionBy(*by)
    ranked = df.withColumns({"at": F.row_number().over(order), "n": F.count("*").over(whole)}).withColumn("cut", F.greatest(F.lit(1), F.floor(F.col("n") / 10)))
    top, low = F.col("at") > F.col("n") - F.col("cut"), F.col("at") <= F.col("cut")
    return ranked.groupBy(*by).agg((F.avg(F.when(top, F.col(value))) - F.avg(F.when(low, F.col(value)))).alias("spread"))


def _selected(ranked: DataFrame, chosen: Column) -> DataFrame:
    """Per date of ranked rows (d, n, asset, fwd): the mean of the chosen and their turnover against the date before; 1 on the first."""
    own = ranked.filter(chosen).select("d", "asset", "fwd")
    met = own.join(own.select((F.col("d") + 1).alias("d"), "asset", F.lit(1).alias("was")), ["d", "asset"], "left")
    found = met.groupBy("d").agg(F.avg("fwd").alias("gross"), (1 - F.count("was") / F.count("*")).alias("turnover"))
    return found.withColumn("turnover", F.when(F.col("d") == 1, 1.0).otherwise(F.col("turnover")))


def momentum_views(panel: DataFrame, cost: float, least: int = 8, tops: tuple[int, ...] = (3, 5)) -> DataFrame:
    """date, view, gross, turnover, net of a panel (date, asset, trail, fwd), on dates with ``least`` assets or more.

    view spread: the mean of the best third by trail less that of the worst, its turnover the mean of both and its
    cost that of both; view top3, top5, ...: the mean of so many best assets. Turnover is the share that was not
    chosen on the qualifying date before; ties of trail go by asset.
    """
    order, back, whole = Window.partitionBy("date").orderBy(F.col("trail").desc(), "asset"), Window.partitionBy("date").orderBy("trail", F.col("asset").desc()), Window.partitionBy("date")
    ranked = panel.withColumns({"at": F.row_number().over(order), "from_last": F.row_number().over(back), "n": F.count("*").over(whole)}).filter(F.col("n") >= least)
    dates = ranked.select("date").distinct().withColumn("d", F.row_number().over(Window.orderBy("date")))
    ranked = ranked.join(F.broadcast(dates), "date")
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    best, worst = (_selected(ranked, F.col(c) <= third) for c in ("at", "from_last"))
    both = best.join(worst.select("d", F.col("gross").alias("low"), F.col("turnover").alias("t2")), "d")
    out = both.select("d", F.lit("spread").alias("view"), (F.col("gross") - F.col("low")).alias("gross"), ((F.col("turnover") + F.col("t2")) / 2).alias("turnover"), (F.col("turnover") + F.col("t2")).alias("traded"))
    for k in tops:
        out = out.unionByName(_selected(ranked, F.col("at") <= k).select("d", F.lit(f"top{k}").alias("view"), "gross", "turnover", F.col("turnover").alias("traded")))
    return out.join(dates, "d").select("date", "view", "gross", "turnover", (F.col("gross") - cost * F.col("traded")).alias("net"))


def economic_views(panel: DataFrame, cost: float, tops: tuple[int, ...] = (3, 5)) -> DataFrame:
    """view, dates, turnover, gross, net: mean over all dates of the best assets' fwd less that of all assets of the date.

    view tercile: a third of the assets of the first date, rounded up, on every date; top3, top5, ...: so many.
    """
    order = Window.partitionBy("date").orderBy(F.col("trail").desc(), "asset")
    dates = panel.select("date").distinct().withColumn("d", F.row_number().over(Window.orderBy("date")))
    ranked = panel.withColumn("at", F.row_number().over(order)).join(F.broadcast(dates), "date")
    first = ranked.filter("d = 1").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 3)).alias("third"))
    ranked, every = ranked.crossJoin(F.broadcast(first)), ranked.groupBy("d").agg(F.avg("fwd").alias("all"))
    out = None
    for name, size in (("tercile", F.col("third")), *((f"top{k}", F.lit(k)) for k in tops)):
        one = _selected(ranked, F.col("at") <= size).join(every, "d").withColumn("gross", F.col("gross") - F.col("all"))
        means = one.agg(F.count("*").alias("dates"), F.avg("turnover").alias("turnover"), F.avg("gross").alias("gross"), F.avg(F.col("gross") - cost * F.col("turnover")).alias("net")).select(F.lit(name).alias("view"), "*")
        out = means if out is None else out.unionByName(means)
    return out


def registry_ranking(entries: DataFrame, *keys: str) -> DataFrame:
    """entries with ``place``: validated ones first, then by value, by number of observations, by fewer parameters; ties by keys.

    entries: (tier, value, n, params: a map).
    """
    order = Window.orderBy(F.when(F.col("tier") == "validated", 0).otherwise(1), F.col("value").desc(), F.col("n").desc(), F.size(F.map_keys("params")), *keys)
    return entries.withColumn("place", F.row_number().over(order))


def slippage(quotes: DataFrame, assumed: float, multiple: float = 2.0, *keys: str, signed: bool = False) -> DataFrame:
    """keys, samples, slip_1k, slip_10k, ratio, flagged: the mean distance of both sides from the mid of the quotes for a small order.

    quotes: (keys, bid_1k, ask_1k, bid_10k, ask_10k); rows with a quote missing or a mid of 0 or less don't count.
    signed: quotes of a level of any sign, which all count.
    """
    mid = (F.col("bid_1k") + F.col("ask_1k")) / 2
    whole = quotes.filter(F.col("bid_10k").isNotNull() & F.col("ask_10k").isNotNull() & (mid.isNotNull() if signed else mid > 0))
    side = lambda size: F.avg((I.ratio(F.col(f"ask_{size}") - mid, mid) + I.ratio(mid - F.col(f"bid_{size}"), mid)) / 2)
    found = whole.groupBy(*keys).agg(F.count("*").alias("samples"), side("1k").alias("slip_1k"), side("10k").alias("slip_10k"))
    ratio = F.col("slip_1k") / assumed
    return found.withColumns({"ratio": ratio, "flagged": ratio >= multiple})


def with_q_values(tests: DataFrame, p: str, family: list[str]) -> DataFrame:
    """tests with q, the step-up false-discovery value: the smallest p * m / rank of this and all larger p-values."""
    order, whole = Window.partitionBy(*family).orderBy(p), Window.partitionBy(*family)
    raw = tests.withColumn("__raw", F.least(F.lit(1.0), F.col(p) * F.count("*").over(whole) / F.row_number().over(order)))
    return raw.withColumn("q", F.min("__raw").over(order.rowsBetween(0, Window.unboundedFollowing))).drop("__raw")


def effective_n(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """by, n, rho, effective: the sample size corrected for the correlation with the row before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    found = df.withColumn("__before", before).groupBy(*by).agg(F.count(value).alias("n"), F.corr(value, "__before").alias("rho"))
    rho = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.coalesce(F.nanvl("rho", F.lit(None)), F.lit(0.0))))
    return found.select(*by, "n", rho.alias("rho"), F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.col("n") * (1 - rho) / (1 + rho))).alias("effective"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: f, between and within degrees of freedom; f is null where one of them is not positive."""
    cells = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).filter("n > 0")
    sums = cells.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between, df1, df2 = F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.col("k") - 1, F.col("n") - F.col("k")
    return sums.select(F.when((df1 > 0) & (df2 > 0) & (F.col("within") > 0), (between / df1) / (F.col("within") / df2)).alias("f"), df1.alias("df_between"), df2.alias("df_within"))


def separations(rows: DataFrame, wins: str, numbers: list[str], flags: list[str]) -> DataFrame:
    """feature, kind, winners, losers, separation, place: how far apart two outcomes are in what was known before.

    Numbers are compared by their means, |w - l| / (|w| + |l| + 1e-9), flags by the percentages that are true, |w - l| / 100; nulls count for neither. A feature that one
    side never has is left out. place: 1 for the widest apart; equal ones, to nine places, by name.
    """
    wide = rows.select(F.col(wins).cast("boolean").alias("__win"), *(F.col(c).cast("double").alias(c) for c in numbers), *(F.col(c).cast("int").cast("double").alias(c) for c in flags)).filter("__win is not null")
    long = wide.unpivot("__win", [*numbers, *flags], "feature", "v").withColumn("kind", F.when(F.col("feature").isin(flags), "flag").otherwise("number"))
    scale = F.when(F.col("kind") == "flag", 100.0).otherwise(1.0)
    found = long.groupBy("feature", "kind").agg(F.avg(F.when(F.col("__win"), F.col("v"))).alias("w"), F.avg(F.when(~F.col("__win"), F.col("v"))).alias("l")).filter("w is not null and l is not null")
    apart = F.abs(F.col("w") - F.col("l"))
    found = found.select("feature", "kind", (scale * F.col("w")).alias("winners"), (scale * F.col("l")).alias("losers"), F.when(F.col("kind") == "flag", apart).otherwise(apart / (F.abs("w") + F.abs("l") + 1e-9)).alias("separation"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.round("separation", 9).desc(), "feature")))  # a row for each feature
