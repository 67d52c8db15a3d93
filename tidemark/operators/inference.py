"""Resampling tests as rows: every replica is a row set of its own, its randomness a digest of its key.

A draw depends on nothing but (seed, replica, key), so repeated tasks and other engines get the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, *parts) -> Column:
    """32 random hexadecimal digits of a key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def replicas(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(k))))


def sign_flip(df: DataFrame, value: str, key: str, k: int, seed: str = "s") -> DataFrame:
    """One row: n, mean, and the one-sided p of the mean under random signs, (at least as large + 1) / (k + 1)."""
    own = df.agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    sign = F.when(F.substring(draw(seed, "replica", key), 1, 1) < "8", 1.0).otherwise(-1.0)
    drawn = replicas(df, k).groupBy("replica").agg(F.avg(sign * F.col(value)).alias("m"))
    return drawn.crossJoin(F.broadcast(own)).groupBy("n", "mean").agg(((F.count_if(F.col("m") >= F.col("mean")) + 1) / (k + 1)).alias("p"))


def bootstrap_interval(df: DataFrame, value: str, order: str, k: int, seed: str = "b", block: int = 1) -> DataFrame:
    """One row: the values at floor(.025 k) and floor(.975 k) of the sorted means of k resamples.

    df: one row per date; the numbering is a window over those rows. A resample is made of blocks of so many
    successive dates, each begun at a drawn place, and cut to the number of dates.
    """
    numbered = df.select((F.row_number().over(Window.orderBy(order)) - 1).alias("at"), F.col(value).alias("x"))
    size = df.agg(F.count("*").alias("n")).withColumn("width", F.least(F.lit(block).cast("long"), F.col("n")))
    spot = F.floor(F.col("at") / F.col("width"))
    begin = F.conv(F.substring(draw(seed, "replica", spot.cast("string")), 1, 8), 16, 10).cast("long") % (F.col("n") - F.col("width") + 1)
    wanted = replicas(numbered.select("at"), k).crossJoin(F.broadcast(size)).select("replica", (begin + F.col("at") % F.col("width")).alias("at"))
    means = wanted.join(numbered, "at").groupBy("replica").agg(F.avg("x").alias("m"))
    place = F.row_number().over(Window.orderBy("m", "replica")) - 1
    edge = means.withColumn("place", place)
    return edge.agg(F.max(F.when(F.col("place") == int(0.025 * k), F.col("m"))).alias("lo"), F.max(F.when(F.col("place") == int(0.975 * k), F.col("m"))).alias("hi"))


def permuted_ic(panel: DataFrame, k: int, seed: str = "p") -> DataFrame:
    """One row: the mean over dates of the correlation of trail and fwd, and its one-sided p.

    A replica pairs a date's trails with its fwds in another order. panel: (date, asset, trail, fwd).
    """
    per = panel.groupBy("date").agg(F.corr("trail", "fwd").alias("ic"))
    own = per.filter(~F.isnan("ic")).agg(F.avg("ic").alias("ic"))
    number = F.row_number().over(Window.partitionBy("date").orderBy("asset"))
    left = panel.select("date", "trail", number.alias("at"))
    shuffled = F.row_number().over(Window.partitionBy("replica", "date").orderBy(draw(seed, "replica", "date", "asset")))
    right = replicas(panel.select("date", "asset", "fwd"), k).select("replica", "date", "fwd", shuffled.alias("at"))
    drawn = right.join(left, ["date", "at"]).groupBy("replica", "date").agg(F.corr("trail", "fwd").alias("r")).filter(~F.isnan("r")).groupBy("replica").agg(F.avg("r").alias("r"))
    return drawn.crossJoin(F.broadcast(own)).groupBy("ic").agg(((F.count_if(F.col("r") >= F.col("ic")) + 1) / (k + 1)).alias("p"))


def _spearman(pairs: DataFrame, *by: str) -> DataFrame:
    """by, r: the rank correlation of trail and fwd in each group; groups without spread have none."""
    place = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2
    return pairs.select(*by, place("trail").alias("x"), place("fwd").alias("y")).groupBy(*by).agg(F.corr("x", "y").alias("r")).filter("not isnan(r)")


def _across_dates(panel: DataFrame, k: int, seed: str, by: str, two_sided: bool) -> DataFrame:
    """One row: ic and p. A replica gives each date the fwds of another; pairs of dates that recur are correlated once."""
    own = _spearman(panel, "date").agg(F.avg("r").alias("ic"))
    dates = panel.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("at"))
    spot = F.row_number().over(Window.partitionBy("replica").orderBy(draw(seed, "replica", "date"), "date"))
    order = replicas(dates.select("date"), k).select("replica", F.col("date").alias("other"), spot.alias("at")).join(dates, "at").select("replica", "date", "other")
    pairs = order.select("date", "other").distinct()
    met = pairs.join(panel.select("date", by, "trail"), "date").join(panel.select(F.col("date").alias("other"), by, "fwd"), ["other", by])
    drawn = order.join(_spearman(met, "date", "other"), ["date", "other"]).groupBy("replica").agg(F.avg("r").alias("r"))
    size = (lambda x: F.abs(F.col(x))) if two_sided else F.col
    # float sums come in any order; equal statistics count as at least as large
    return drawn.crossJoin(F.broadcast(own)).groupBy("ic").agg(((F.count_if(size("r") >= size("ic") - 1e-12) + 1) / (k + 1)).alias("p"))


def permuted_panels(panel: DataFrame, k: int, seed: str = "q") -> DataFrame:
    """One row: the mean over dates of the rank correlation of trail and fwd, and its one-sided p.

    A replica pairs the trails of each date with the fwds, asset by asset, of another date in a random
    order of all dates. panel: (date, asset, trail, fwd).
    """
    return _across_dates(panel, k, seed, "asset", False)


def permuted_vectors(panel: DataFrame, k: int, seed: str = "v") -> DataFrame:
    """As permuted_panels(), two-sided, with trails and fwds paired by place in the order of assets, up to the shorter one's end."""
    place = F.row_number().over(Window.partitionBy("date").orderBy("asset"))
    return _across_dates(panel.withColumn("place", place), k, seed, "place", True)


def block_permuted_ic(rows: DataFrame, block: int, k: int, seed: str = "k") -> DataFrame:
    """symbol, n, ic, p: rank correlation of x and y and its two-sided p under permuted blocks of the y of a symbol.

    rows: (symbol, time, x, y). Ranks are taken once, as a permutation only moves them. A block's new place is the
    sum of the sizes of the blocks before it in the replica's order.
    """
    place = lambda c: F.rank().over(Window.partitionBy("symbol").orderBy(c)) + (F.count("*").over(Window.partitionBy("symbol", c)) - 1) / 2
    at = F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1
    ranked = rows.select("symbol", place("x").alias("rx"), place("y").alias("ry"), at.alias("at")).withColumn("block", F.floor(F.col("at") / block))
    own = ranked.groupBy("symbol").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("ic"))
    sizes = replicas(ranked.groupBy("symbol", "block").agg(F.count("*").alias("size")), k)
    order = Window.partitionBy("symbol", "replica").orderBy(draw(seed, "replica", "symbol", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    begun = sizes.withColumn("begin", F.coalesce(F.sum("size").over(order), F.lit(0))).select("symbol", "replica", "block", "begin")
    moved = begun.join(ranked.select("symbol", "block", "ry", "at"), ["symbol", "block"]).select("symbol", "replica", (F.col("begin") + F.col("at") % block).alias("at"), "ry")
    drawn = moved.join(ranked.select("symbol", "at", "rx"), ["symbol", "at"]).groupBy("symbol", "replica").agg(F.corr("rx", "ry").alias("r"))
    found = drawn.join(own, "symbol").groupBy("symbol", "n", "ic")
    return found.agg(((F.count_if(F.abs("r") >= F.abs("ic") - 1e-12) + 1) / (k + 1)).alias("p"))


def half_life(slope: Column) -> Column:
    """Periods until half of a deviation is gone, of the slope of its changes on it; null outside (-1, 0)."""
    return F.when((slope > -1) & (slope < 0), F.log(F.lit(0.5)) / F.log1p(slope))


def permuted_anova(df: DataFrame, value: str, group: str, key: list[str], k: int, seed: str = "a") -> DataFrame:
    """One row: f of the one-way analysis of variance and its p under permuted groups.

    A replica deals the values, in the order of digests of (seed, replica, key), to groups of the true sizes. Places are
    counted by the digest's first digits before they are counted inside. The total sum of squares does not
    change, so f is as large where the sum of squares between groups is.
    """
    own = df.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).filter("n > 0")
    whole = own.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    upto = F.sum("n").over(Window.orderBy(group))
    bounds = own.select(F.col("n").alias("size"), (upto - F.col("n")).alias("from"), upto.alias("upto"), F.col(group).alias("__group"))
    drawn = replicas(df.filter(F.col(value).isNotNull()).select(*key, F.col(value).alias("x")), k).withColumn("h", draw(seed, "replica", *key)).withColumn("digits", F.substring("h", 1, 3))
    before = F.sum("c").over(Window.partitionBy("replica").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1))
    sizes = drawn.groupBy("replica", "digits").agg(F.count("*").alias("c")).select("replica", "digits", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("replica", "digits").orderBy("h", *key)) - 1
    placed = drawn.join(sizes, ["replica", "digits"]).select("replica", "x", place.alias("place"))
    dealt = placed.join(F.broadcast(bounds), (F.col("place") >= F.col("from")) & (F.col("place") < F.col("upto")))
    sums = dealt.groupBy("replica", "__group", "size").agg(F.sum("x").alias("s")).groupBy("replica").agg(F.sum(F.col("s") * F.col("s") / F.col("size")).alias("r"))
    between, df1, df2 = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("k") - 1, F.col("n") - F.col("k")
    f = F.when((df1 > 0) & (df2 > 0), F.try_divide(between / F.nullif(df1, F.lit(0)), F.nullif((F.col("q") - F.col("b")) / F.nullif(df2, F.lit(0)), F.lit(0.0))))
    met = sums.crossJoin(F.broadcast(whole.withColumn("f", f)))
    return met.groupBy("f").agg(((F.count_if(F.col("r") >= F.col("b") - 1e-9) + 1) / (k + 1)).alias("p"))


def dickey_fuller(series: DataFrame, value: str, *keys: str, order: str = "time") -> DataFrame:
    """keys, n, rho, t: the change on a constant, the level before and the change before, and the t of the level.

    The fit of two regressors is that of their sums of products, so a series is one aggregate.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    step = series.withColumn("d", F.col(value) - F.lag(value).over(w)).withColumns({"e": F.lag(value).over(w), "d1": F.lag("d").over(w)}).filter("d1 is not null")
    pairs = {"ee": ("e", "e"), "dd": ("d1", "d1"), "ed": ("e", "d1"), "ey": ("e", "d"), "dy": ("d1", "d"), "yy": ("d", "d")}
    sums = step.groupBy(*keys).agg(F.count("*").alias("n"), *(F.covar_pop(a, b).alias(c) for c, (a, b) in pairs.items()))
    free = F.col("ee") * F.col("dd") - F.col("ed") * F.col("ed")
    rho = (F.col("ey") * F.col("dd") - F.col("dy") * F.col("ed")) / F.when(F.abs(free) > 1e-12, free)
    phi = (F.col("dy") * F.col("ee") - F.col("ey") * F.col("ed")) / F.when(F.abs(free) > 1e-12, free)
    rest = F.col("n") * (F.col("yy") - rho * F.col("ey") - phi * F.col("dy"))
    error = F.sqrt(F.greatest(F.lit(0.0), rest / F.when(F.col("n") > 3, F.col("n") - 3) * F.col("dd") / (F.col("n") * F.when(F.abs(free) > 1e-12, free))))
    return sums.select(*keys, "n", rho.alias("rho"), F.when(error > 0, rho / error).alias("t"))


def _pulled(y: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """For each row of x: the fit of y on it, and of the changes of its residuals on a constant, the level before and the change before."""
    n = x.shape[1]
    xc, yc = x - x.mean(axis=1, keepdims=True), y - y.mean()
    spread = (xc * xc).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        beta = (xc @ yc) / spread
        alpha = y.mean() - beta * x.mean(axis=1)
        rest = y - alpha[:, None] - beta[:, None] * x
        step = np.diff(rest, axis=1)
        d, e, b = (z - z.mean(axis=1, keepdims=True) for z in (step[:, 1:], rest[:, 1:-1], step[:, :-1]))
        ee, bb, eb, ed, bd, dd = ((p * q).sum(axis=1) for p, q in ((e, e), (b, b), (e, b), (e, d), (b, d), (d, d)))
        free = ee * bb - eb * eb
        rho, phi = (ed * bb - bd * eb) / free, (bd * ee - ed * eb) / free
        error = np.sqrt(np.maximum(0, (dd - rho * ed - phi * bd) / (n - 5) * bb / free))
        t = rho / error
    return {"alpha": alpha, "beta": beta, "rho": rho, "t": np.where((spread > 1e-10) & (free > 1e-10) & np.isfinite(t), t, np.nan)}


def pair_null(pairs: DataFrame, k: int = 200, block: int = 20, seed: str = "c", least: int = 17) -> DataFrame:
    """one, other, n, alpha, beta, rho, t, half_life, p, drawn: does the spread of each pair pull back, against permuted paths.

    pairs: (one, other, time, y, x), of ``least`` rows or more. A replica keeps y and moves blocks of the changes of x, which are added up again from the first x; p is the
    share of replicas whose t is as low, (hits + 1) / (drawn + 1) over those that have one, null where the pair has none. A pair's common history is one group: rows of
    two numbers, and replicas in runs of bounded size.
    """
    names = ["one", "other", "n", "alpha", "beta", "rho", "t", "p", "drawn"]
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def test(table: pa.Table) -> pa.Table:
        table = table.sort_by("time")
        one, other, n = table["one"][0].as_py(), table["other"][0].as_py(), table.num_rows
        if n < least:
            return made.empty_table()
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        true = {c: float(v[0]) for c, v in _pulled(y, x[None]).items()}
        moves = np.diff(x)
        begins = range(0, n - 1, block)
        drawn, run = [], max(1, (1 << 20) // n)
        for first in range(1, k + 1, run):
            paths = []
            for replica in range(first, min(first + run, k + 1)):
                order = sorted(range(len(begins)), key=lambda b: hashlib.md5(f"{seed}|{replica}|{one}|{other}|{b}".encode()).hexdigest())  # noqa: B023
                paths.append(x[0] + np.append(0, np.cumsum(np.concatenate([moves[begins[b] : begins[b] + block] for b in order]))))
            drawn.append(_pulled(y, np.stack(paths))["t"])
        ts = np.concatenate(drawn)
        ts = ts[~np.isnan(ts)]
        p = None if np.isnan(true["t"]) or not len(ts) else (int((ts <= true["t"] + 1e-12).sum()) + 1) / (len(ts) + 1)
        row = [one, other, n, *(None if np.isnan(true[c]) else true[c] for c in names[3:7]), p, len(ts)]
        return pa.Table.from_pylist([dict(zip(names, row, strict=True))], schema=made)

    made = pa.schema([("one", pa.string()), ("other", pa.string()), ("n", pa.int64()), *((c, pa.float64()) for c in names[3:8]), ("drawn", pa.int64())])
    told = pairs.select(F.col("one").cast("string").alias("one"), F.col("other").cast("string").alias("other"), "time", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).filter("y is not null and x is not null")
    found = told.groupBy("one", "other").applyInArrow(test, "one string, other string, n long, alpha double, beta double, rho double, t double, p double, drawn long")
    return found.select(F.col("one").cast(kinds["one"]).alias("one"), F.col("other").cast(kinds["other"]).alias("other"), "n", "alpha", "beta", "rho", "t", half_life(F.col("rho")).alias("half_life"), "p", "drawn")


def regression(rows: DataFrame, y: str, xs: list[str], *by: str, singular: str = "error") -> DataFrame:
    """by, n, r2, intercept, slopes, errors: least squares of y on a constant and xs in each group; errors begin with the intercept's.

    One pass takes the means and the centred products of each group; the small system is solved with pivoting. Rows with a null are
    left out. A group whose system is singular, or with no more rows than coefficients, ends the query, or has nulls with ``singular="null"``.
    """
    names = [*xs, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    whole = rows.dropna(subset=names).select(*by, *(F.col(c).cast("double").alias(c) for c in names))
    sums = whole.groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in names)).alias("means"), F.array(*(F.covar_pop(names[i], names[j]) for i, j in pairs)).alias("products"))
    size = len(xs)

    def solve(batches):
        for batch in batches:
            out = []
            for n, means, products in zip(*(batch.column(c).to_pylist() for c in ("n", "means", "products")), strict=True):
                c = np.zeros((size + 1, size + 1))
                for (i, j), v in zip(pairs, products, strict=True):
                    c[i, j] = c[j, i] = v
                scale = np.sqrt(np.diag(c)[:size])
                good = n > size + 1 and (scale > 0).all() and np.linalg.matrix_rank(c[:size, :size] / np.outer(scale, scale), tol=1e-10) == size if size else n > 1
                if not good:
                    if singular == "error":
                        raise ValueError("a group's regressors are collinear, constant, or too many for its rows")
                    out.append((None, None, None, None))
                    continue
                slopes = np.linalg.solve(c[:size, :size], c[:size, size])
                rest = max(0.0, c[size, size] - slopes @ c[:size, size]) * n
                inverse = np.linalg.inv(c[:size, :size] * n)
                m, variance = np.asarray(means[:size]), rest / (n - size - 1)
                errors = np.sqrt(variance * np.append(1 / n + m @ inverse @ m, np.diag(inverse)))
                r2 = 1 - rest / (c[size, size] * n) if c[size, size] > 0 else None
                out.append((r2, float(means[size] - slopes @ m), slopes.tolist(), errors.tolist()))
            kinds = (pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "n")), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], [*by, "n", "r2", "intercept", "slopes", "errors"])

    keys = "".join(f"{c} {sums.schema[c].dataType.simpleString()}, " for c in by)
    return sums.mapInArrow(solve, f"{keys}n long, r2 double, intercept double, slopes array<double>, errors array<double>")
