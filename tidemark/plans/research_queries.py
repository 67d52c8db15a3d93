"""Discovery of rules, searches over configurations, and tests with nulls of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import discovery as D
from tidemark.operators import entries as E
from tidemark.operators import indicators as I
from tidemark.operators import inference as R
from tidemark.operators import positions as X
from tidemark.operators import search
from tidemark.operators import splits as P
from tidemark.operators.stats import separations, with_q_values
from tidemark.plans import lenses as L
from tidemark.plans.bar_queries import B60, S
from tidemark.plans.base import Catalog, rounded
from tidemark.plans.trade_queries import biased
from tidemark.plans.trade_queries import catalog as trade_catalog
from tidemark.sources.tables import settled

catalog = Catalog()
query = catalog.query
#: The symbol whose state is known at the entries of all others, and the share that each side of a trade pays.
LEADER, COST = "click", 0.0045
X3 = trade_catalog.sql["x3_profile"]


def profiles(spark, sf, mode: str = "ma_dip", horizon: int = 100):
    """symbol, time, r (net of costs) and what was known at the entry, of each closed candidate of a mode."""
    bars = biased(spark, sf, E.with_levels(settled(E.prepared(L.bars(spark, sf)), "prepared")))
    gap = F.when(F.lag("high", 2).over(I.by_time()) < F.col("low"), F.col("low"))
    bars = bars.withColumns({"gap_low": gap, "day": F.floor(F.col("time") / 86400), "change24": I.change("close", 24)}).withColumn("gap", F.coalesce(F.min("gap_low").over(I.frame(-14, 0)) <= F.col("close"), F.lit(False)))
    bars = settled(bars, "profiles")  # read by the entries, their outcomes and what was known
    days = bars.groupBy("symbol", (F.col("day") + 1).alias("day")).agg(F.max("high").alias("day_high"), F.min("low").alias("day_low"))
    leader = bars.filter(F.col("symbol") == LEADER).select("time", F.col("bias240").alias("lead_bias"), F.col("change24").alias("lead_change"))
    entries = E.candidates(bars, mode, min_stop=None).filter("reason = 'taken'")
    known = E.profile(bars, entries, horizon).filter("outcome <> 'open'")
    more = bars.join(days, ["symbol", "day"], "left").join(leader, "time", "left").select("symbol", "i", "time", "close", "bias240", "bias720", "gap", "lead_bias", "lead_change", "day_high", "day_low", ((F.col("high") - F.col("low")) / F.nullif(F.col("atr_before"), F.lit(0.0))).alias("displacement"))
    met = known.join(more, ["symbol", "i"]).join(entries.select("symbol", "i", "entry", "stop", "target"), ["symbol", "i"])
    left = F.when(F.col("outcome") == "win", F.col("target")).otherwise(F.col("stop"))
    r = (left - F.col("entry") - COST * (F.col("entry") + left)) / (F.col("entry") - F.col("stop"))
    return met.withColumns({"r": r, "mid_bias": F.col("bias240"), "high_bias": F.col("bias720"), "low_share": (F.col("entry") - F.col("day_low")) / F.col("entry"), "high_share": (F.col("day_high") - F.col("entry")) / F.col("entry")})


@query("i9_rule_discovery")
def _(spark, sf):
    """35 rules on the profiles of dips below the mean, under 1000 orders of whole days."""
    return D.discover(profiles(spark, sf), D.predicates(), "r", ["symbol", "i"], 1000)


@query("i14_pair_null")
def _(spark, sf):
    """Every pair of weekly series under 200 paths of permuted blocks of 20 changes, with step-up values."""
    weeks = L.weekly(spark, sf)
    a, b = (weeks.select(F.col("week").alias("time"), F.col("symbol").alias(s), F.log("close").alias(c)) for s, c in (("one", "y"), ("other", "x")))
    tests = R.pair_null(a.join(b, "time").filter("one < other"), 200, 20).withColumn("family", F.col("p").isNotNull())
    return with_q_values(tests, "p", ["family"]).withColumn("q", F.when(F.col("family"), F.col("q"))).drop("family")


@query("i12_regression_of_three", f"""{B60}, x AS (SELECT symbol, close - lag(close) OVER s AS y, lag(buy_vol - sell_vol) OVER s AS a, lag(volume) OVER s AS b, lag(high - low) OVER s AS c FROM b{S}), k AS (SELECT symbol, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc, covar_pop(a, y) AS ay, covar_pop(b, y) AS wy, covar_pop(c, y) AS cy, covar_pop(y, y) AS yy FROM x WHERE a IS NOT NULL AND y IS NOT NULL GROUP BY 1),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM k), i AS (SELECT *, (bb * cc - bc * bc) / det AS i11, (ac * bc - ab * cc) / det AS i12, (ab * bc - ac * bb) / det AS i13, (aa * cc - ac * ac) / det AS i22, (ab * ac - aa * bc) / det AS i23, (aa * bb - ab * ab) / det AS i33 FROM d),
s AS (SELECT *, i11 * ay + i12 * wy + i13 * cy AS s1, i12 * ay + i22 * wy + i23 * cy AS s2, i13 * ay + i23 * wy + i33 * cy AS s3 FROM i), r AS (SELECT *, yy - s1 * ay - s2 * wy - s3 * cy AS rest FROM s)
SELECT symbol, n, round(1 - rest / yy, 6) AS r2, round(my - s1 * ma - s2 * mb - s3 * mc, 4) AS intercept, round(s1, 5) AS flow, round(s2, 5) AS volume, round(s3, 5) AS width, round(sqrt(rest / (n - 4) * i11), 5) AS flow_error, round(sqrt(rest / (n - 4) * (1 + ma * (i11 * ma + i12 * mb + i13 * mc) + mb * (i12 * ma + i22 * mb + i23 * mc) + mc * (i13 * ma + i23 * mb + i33 * mc))), 4) AS intercept_error FROM r""")
def _(spark, sf):
    """The next hour's change on the flow, volume and width of the hour before."""
    before = lambda c: F.lag(c).over(I.by_time())
    rows = L.bars(spark, sf).select("symbol", (F.col("close") - before("close")).alias("y"), before(F.col("buy_vol") - F.col("sell_vol")).alias("a"), before("volume").alias("b"), before(F.col("high") - F.col("low")).alias("c"))
    found = R.regression(rows, "y", ["a", "b", "c"], "symbol")
    slope = lambda k: F.round(F.col("slopes")[k], 5)
    return found.select("symbol", "n", F.round("r2", 6).alias("r2"), F.round("intercept", 4).alias("intercept"), slope(0).alias("flow"), slope(1).alias("volume"), slope(2).alias("width"), F.round(F.col("errors")[1], 5).alias("flow_error"), F.round(F.col("errors")[0], 4).alias("intercept_error"))


@query("i19_strategy_search")
def _(spark, sf):
    """176 configurations chosen on the earlier bars; the later ones are read for the twelve best only."""
    return search.strategy_search(L.bars(spark, sf), least=20)


@query("i19_volume_gate")
def _(spark, sf):
    """Breakouts by the least relative volume; the later bars are read for the best threshold that passed alone."""
    train, holdout = (settled(E.prepared(x), "prepared") for x in search.halves(L.bars(spark, sf)))

    def scores(bars, wanted=None):
        share = F.try_divide("volume", "vol20")
        found = E.candidates(bars.withColumn("share", share), "breakout", min_stop=None).filter("reason = 'taken'").join(bars.select("symbol", "i", share.alias("share")), ["symbol", "i"])
        thresholds = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 2.0)], "threshold double") if wanted is None else wanted
        asked = found.join(F.broadcast(thresholds), F.col("share") >= F.col("threshold")).drop("share")
        return search.scored(X.simulate(bars, asked, [X.Exit("live")], ("symbol", "threshold")), "threshold")

    return search.gated(scores(train), lambda chosen: scores(holdout, chosen), "threshold", (-0.5, 20), (-0.3, 8, 0.4), best_only=True)


@query("a18_profiles", f"""WITH rows AS ({X3}), z AS (SELECT outcome = 'win' AS win, unnest(['stop_share', 'ma_share', 'volume_ratio', 'atr_share', 'busy', 'stretched']) AS feature, unnest([stop_share, ma_share, volume_ratio, atr_share, (volume_ratio > 1.5)::INT, (ma_share > 0.01)::INT]) AS v FROM rows WHERE outcome <> 'open'),
g AS (SELECT feature, CASE WHEN feature IN ('busy', 'stretched') THEN 'flag' ELSE 'number' END AS kind, avg(v) FILTER (win) AS w, avg(v) FILTER (NOT win) AS l FROM z GROUP BY 1), s AS (SELECT feature, kind, w, l, CASE kind WHEN 'flag' THEN abs(w - l) ELSE abs(w - l) / (abs(w) + abs(l) + 1e-9::DOUBLE) END AS separation FROM g WHERE w IS NOT NULL AND l IS NOT NULL)
SELECT feature, kind, round(w * CASE kind WHEN 'flag' THEN 100 ELSE 1 END, 6) AS winners, round(l * CASE kind WHEN 'flag' THEN 100 ELSE 1 END, 6) AS losers, round(separation, 6) AS separation, row_number() OVER (ORDER BY round(separation, 9) DESC, feature)::INT AS place FROM s QUALIFY place <= 3""")
def _(spark, sf):
    """The three features that tell winning from losing breakouts best."""
    rows = trade_catalog.queries["x3_profile"](spark, sf).filter("outcome <> 'open'").withColumns({"win": F.col("outcome") == "win", "busy": F.col("volume_ratio") > 1.5, "stretched": F.col("ma_share") > 0.01})
    found = separations(rows, "win", ["stop_share", "ma_share", "volume_ratio", "atr_share"], ["busy", "stretched"])
    return rounded(found.filter("place <= 3"), "winners", "losers", "separation")


INTERVALS = (60, 240, 1440)


def in_intervals(spark, sf):
    """Bars of an hour, four hours and a day, told apart by minutes."""
    parts = [L.bars(spark, sf, m).select("symbol", "time", F.lit(m).alias("minutes")) for m in INTERVALS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


EVERY = f"WITH {L.MINUTES}{L.coarse('b')}{L.coarse('b4', 240)}{L.coarse('bd', 1440)}, al AS (SELECT symbol, time, 60 AS minutes FROM b UNION ALL SELECT symbol, time, 240 FROM b4 UNION ALL SELECT symbol, time, 1440 FROM bd), pl AS (SELECT symbol, time, row_number() OVER s - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b{S})"


@query("i16_anchored_folds", f"""{EVERY}, ct AS (SELECT DISTINCT symbol, fold, floor(n * 0.5::DOUBLE)::BIGINT + (fold - 1) * ((n - floor(n * 0.5::DOUBLE)::BIGINT) // 4) AS cut, CASE fold WHEN 4 THEN n ELSE floor(n * 0.5::DOUBLE)::BIGINT + fold * ((n - floor(n * 0.5::DOUBLE)::BIGINT) // 4) END AS fin FROM pl, (SELECT unnest([1, 2, 3, 4]) AS fold)),
wd AS (SELECT c.symbol, fold, x.time AS a, y.time AS z FROM ct c JOIN pl x ON x.symbol = c.symbol AND x.i = c.cut - 1 JOIN pl y ON y.symbol = c.symbol AND y.i = c.fin - 1 WHERE cut < fin) SELECT al.symbol, minutes, fold, CASE WHEN time <= a THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, max(time) AS last FROM al JOIN wd ON wd.symbol = al.symbol AND time <= z GROUP BY ALL""")
def _(spark, sf):
    """Four growing folds cut on the hour bars, applied to three intervals by time."""
    return P.in_folds(in_intervals(spark, sf), P.walk_forward(L.bars(spark, sf))).groupBy("symbol", "minutes", "fold", "part").agg(F.count("*").alias("n"), F.max("time").alias("last"))


@query("i18_anchored_epochs", f"""{EVERY}, bs AS (SELECT DISTINCT symbol, epoch, (SELECT time FROM pl p WHERE p.symbol = q.symbol AND p.i = q.n * epoch // 5) AS b FROM (SELECT DISTINCT symbol, n, unnest([0, 1, 2, 3, 4]) AS epoch FROM pl) q), sp AS (SELECT symbol, epoch, b, lead(b) OVER (PARTITION BY symbol ORDER BY epoch) AS e FROM bs)
SELECT al.symbol, minutes, epoch, count(*) AS n, min(time) AS first FROM al JOIN sp ON sp.symbol = al.symbol AND time >= b AND (e IS NULL OR time < e) GROUP BY 1, 2, 3""")
def _(spark, sf):
    """Five epochs of equal counts of hour bars, applied to three intervals by time."""
    return P.in_epochs(in_intervals(spark, sf), P.epochs(L.bars(spark, sf), 5)).groupBy("symbol", "minutes", "epoch").agg(F.count("*").alias("n"), F.min("time").alias("first"))


_KINDS = {
    "fraction": "SELECT b.symbol, b.time >= c.time AS late FROM b JOIN pl c ON c.symbol = b.symbol AND c.i = floor(c.n * 0.7::DOUBLE)", "time": "SELECT symbol, time >= 1706000000 AS late FROM b", "recent_days": "SELECT symbol, time >= (SELECT max(time) FROM b) - 3 * 86400 AS late FROM b",
    "recent_dates": "SELECT symbol, time // 86400 IN (SELECT DISTINCT time // 86400 AS d FROM b ORDER BY d DESC LIMIT 4) AS late FROM b", "symbol": "SELECT symbol, symbol = 'view' AS late FROM b WHERE symbol <> 'error'",
    "window": "SELECT w.symbol, w.time >= c.time AS late FROM (SELECT * FROM b WHERE time BETWEEN 1705000000 AND 1706000000) w JOIN (SELECT symbol, time, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b WHERE time BETWEEN 1705000000 AND 1706000000) c ON c.symbol = w.symbol AND c.i = floor(c.n * 0.7::DOUBLE)",
}


@query("i17_splits", EVERY + ", " + ", ".join(f"k_{k} AS ({sql})" for k, sql in _KINDS.items()) + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, symbol, count(*) FILTER (NOT late) AS train, count(*) FILTER (late) AS holdout FROM k_{k} GROUP BY 2" for k in _KINDS))
def _(spark, sf):
    """Hour bars parted in six ways."""
    bars = L.bars(spark, sf).select("symbol", "time", F.floor(F.col("time") / 86400).alias("date"))
    parted = {
        "fraction": P.by_fraction(bars, bars), "time": P.by_time(bars, 1_706_000_000), "recent_days": P.by_recent_days(bars, 3), "recent_dates": P.by_recent_dates(bars, 4), "symbol": P.by_symbol(bars, ["click", "purchase", "signup", "view"], ["view"]),
        "window": P.by_window(bars, bars, 1_705_000_000, 1_706_000_000),
    }
    out = None
    for kind, rows in parted.items():
        found = rows.groupBy("symbol").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "holdout").alias("holdout")).select(F.lit(kind).alias("kind"), "symbol", "train", "holdout")
        out = found if out is None else out.unionByName(found)
    return out
