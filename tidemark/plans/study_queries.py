"""Costs, allocations, resampling tests and the classifier."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import allocation as C
from tidemark.operators import indicators as I
from tidemark.operators import inference as R
from tidemark.operators import joins as J
from tidemark.operators import learning as M
from tidemark.operators import rules as W
from tidemark.plans import lenses as L
from tidemark.plans.bar_queries import B60, BREAK, S, breakouts, full, over
from tidemark.plans.base import Catalog, r6, rounded
from tidemark.plans.join_queries import MOVES, PANEL, moves, panel

catalog = Catalog()
query = catalog.query
RUN = "OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)"
TIERS = [(0, 0.0006, 0.0010), (20, 0.0004, 0.0008), (40, 0.0002, 0.0006)]


@query("c1_fee_tiers", f"WITH {L.WEEKLY}, t(least, maker, taker) AS (VALUES {', '.join(f'({a}::DOUBLE, {m}::DOUBLE, {t}::DOUBLE)' for a, m, t in TIERS)}) SELECT symbol, week, maker, taker FROM wk, t WHERE least = (SELECT max(least) FROM t u WHERE u.least <= wk.volume)")
def _(spark, sf):
    return C.fee_tiers(L.weekly(spark, sf), TIERS).select("symbol", "week", "maker", "taker")


@query("c2_funding_cost", f"{B60}, p AS (SELECT symbol, time AS entry, time + 36000 AS exit FROM b) SELECT p.symbol, p.entry, coalesce(sum(b.buy_vol - b.sell_vol), 0) AS funding FROM p LEFT JOIN b ON b.symbol = p.symbol AND b.time >= p.entry AND b.time < p.exit GROUP BY 1, 2")
def _(spark, sf):
    """A position of ten hours from every bar; the hourly flow stands for the rate."""
    bars = L.bars(spark, sf)
    positions = bars.select("symbol", F.col("time").alias("entry"), (F.col("time") + 36000).alias("exit"))
    return C.funding_cost(positions, bars.select("symbol", "time", (F.col("buy_vol") - F.col("sell_vol")).alias("rate"))).drop("exit")


@query("c6_cost_surface", f"{B60}, t AS (SELECT symbol, lag(close) OVER s AS entry, close AS px, 20.0::DOUBLE AS risk FROM b{S}), z AS (SELECT symbol, count(*) AS n, sum((px - entry) / risk) AS gross, sum((px + entry) / risk) AS unit FROM t WHERE entry IS NOT NULL GROUP BY 1) SELECT symbol, fee, slip, n, round((gross - (fee + slip) * unit) / n, 6) AS net FROM z, (SELECT unnest([0.0, 0.001, 0.002, 0.004]::DOUBLE[]) AS fee), (SELECT unnest([0.0, 0.0005, 0.001]::DOUBLE[]) AS slip)")
def _(spark, sf):
    trades = L.bars(spark, sf).select("symbol", F.lag("close").over(I.by_time()).alias("entry"), F.col("close").alias("px"), F.lit(20.0).alias("risk")).filter("entry is not null")
    return rounded(C.cost_surface(trades, [0.0, 0.001, 0.002, 0.004], [0.0, 0.0005, 0.001], "symbol"), "net")


@query("c9_sized_equity", f"{MOVES}, d AS (SELECT *, CASE WHEN r <= 0 THEN 1 ELSE 0 END AS d FROM y), i AS (SELECT *, sum(1 - d) {RUN} AS island FROM d), k AS (SELECT *, sum(d) OVER (PARTITION BY symbol, island ORDER BY time ROWS UNBOUNDED PRECEDING) AS streak FROM i), st AS (SELECT symbol, time, r, pow(2::DOUBLE, least(coalesce(lag(streak) OVER s, 0), 3)) AS stake FROM k{S}) SELECT symbol, time, stake, 1000 + sum(stake * r) {RUN} AS equity FROM st")
def _(spark, sf):
    return C.sized_equity(moves(spark, sf).select("symbol", "time", "r"), 1000.0, 3).select("symbol", "time", "stake", "equity")


@query("c10_interval_buys", f"WITH {L.WEEKLY}, k AS (SELECT symbol, week AS time, close, CASE WHEN (row_number() OVER (PARTITION BY symbol ORDER BY week) - 1) % 4 = 0 THEN 1.0::DOUBLE ELSE 0 END AS buy FROM wk), v AS (SELECT symbol, time, sum(buy) {RUN} AS invested, close * sum(buy / close) {RUN} AS value FROM k) SELECT symbol, max(invested) AS invested, round(arg_max(value, time), 6) AS value, round(arg_max(value / invested - 1, time), 6) AS ret FROM v GROUP BY 1")
def _(spark, sf):
    run = C.fixed_interval_buys(L.weekly(spark, sf).withColumnRenamed("week", "time"), 4)
    return run.groupBy("symbol").agg(F.max("invested").alias("invested"), r6(F.max_by("value", "time")).alias("value"), r6(F.max_by(F.col("value") / F.col("invested") - 1, "time")).alias("ret"))


@query("c10_buy_and_hold", f"WITH {L.WEEKLY} SELECT symbol, round(arg_max(close, week) / arg_min(close, week), 6) AS value FROM wk GROUP BY 1")
def _(spark, sf):
    return rounded(C.buy_and_hold(L.weekly(spark, sf).withColumnRenamed("week", "time")), "value")


CARRIED = f"""WITH {L.WEEKLY}, dt AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS k FROM (SELECT DISTINCT week FROM wk)), kn AS (SELECT symbol, k, close FROM wk JOIN dt USING (week)), fs AS (SELECT symbol, min(k) AS first FROM kn GROUP BY 1),
hd AS (SELECT fs.symbol, dt.k, first, last_value(kn.close IGNORE NULLS) OVER (PARTITION BY fs.symbol ORDER BY dt.k ROWS UNBOUNDED PRECEDING) AS price FROM fs JOIN dt ON dt.k >= fs.first LEFT JOIN kn ON kn.symbol = fs.symbol AND kn.k = dt.k)"""


@query("c10_shared_interval_buys", f"""{CARRIED}, bu AS (SELECT symbol, k, price, CASE WHEN k % 4 = 0 THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY k) * (1 - 0.0085::DOUBLE) / price ELSE 0 END AS buy FROM hd), un AS (SELECT k, price, sum(buy) OVER (PARTITION BY symbol ORDER BY k ROWS UNBOUNDED PRECEDING) AS units FROM bu), vl AS (SELECT k, sum(units * price) AS value FROM un GROUP BY 1),
rn AS (SELECT k, week, value, sum(CASE WHEN k % 4 = 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (ORDER BY k) AS invested FROM dt JOIN vl USING (k)) SELECT week AS time, invested, round(value, 6) AS value, round(value / invested, 6) AS ratio, round(value / invested / greatest(1, max(value / invested) OVER (ORDER BY k)) - 1, 6) AS drawdown FROM rn""")
def _(spark, sf):
    """Money on every fourth week of the shared calendar, split among the symbols seen so far."""
    return rounded(C.shared_interval_buys(L.weekly(spark, sf).withColumnRenamed("week", "time"), 4), "value", "ratio", "drawdown")


@query("c10_shared_hold", f"""{CARRIED}, ow AS (SELECT k, price, first_value(price) OVER (PARTITION BY symbol ORDER BY k) AS p0 FROM hd WHERE first = 0), vl AS (SELECT k, sum(price / p0) / count(*) * (1 - 0.0085::DOUBLE) AS value FROM ow GROUP BY 1), rn AS (SELECT week, k, coalesce(value, 0) AS value FROM dt LEFT JOIN vl USING (k)) SELECT week AS time, round(value, 6) AS value, round(value / greatest(1, max(value) OVER (ORDER BY k)) - 1, 6) AS drawdown FROM rn""")
def _(spark, sf):
    return rounded(C.shared_buy_and_hold(L.weekly(spark, sf).withColumnRenamed("week", "time")), "value", "drawdown")


@query("c11_grid_levels", f"{B60}, g AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM b GROUP BY 1) SELECT symbol, k, round(lo * pow(hi / lo, k / 9.0), 6) AS level FROM g, (SELECT unnest(range(10)) AS k) WHERE hi > lo AND lo > 0")
def _(spark, sf):
    ranges = L.bars(spark, sf).groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    return C.grid_levels(ranges, 10).select("symbol", F.col("k").cast("long").alias("k"), r6("level").alias("level"))


@query("c14_portfolio", f"""{PANEL}, dy AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS d FROM (SELECT DISTINCT date FROM pn)), q AS (SELECT pn.*, d, d // 4 AS reb FROM pn JOIN dy USING (date)),
w AS (SELECT reb, asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY reb) AS w FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY trail DESC, asset) AS k FROM q WHERE d % 4 = 0) WHERE k <= 5),
e AS (SELECT q.date, q.d, q.reb, sum(w * fwd) / sum(w) AS ret FROM q JOIN w USING (reb, asset) GROUP BY ALL),
t AS (SELECT coalesce(a.reb, b.reb + 1) AS reb, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS turnover FROM w a FULL JOIN w b ON a.asset = b.asset AND a.reb = b.reb + 1 GROUP BY 1),
z AS (SELECT date, ret, CASE WHEN d % 4 = 0 THEN turnover ELSE 0 END AS turnover FROM e JOIN t USING (reb))
SELECT date, round(ret, 6) AS ret, round(turnover, 6) AS turnover, round(ln(exp(sum(ln((1 - turnover * 0.009) * (1 + ret))) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING))), 5) AS growth FROM z""")
def _(spark, sf):
    run = C.rebalanced_portfolio(panel(spark, sf), 4, 5, 0.009)
    return rounded(run, "ret", "turnover").select("date", "ret", "turnover", F.round(F.log("equity"), 5).alias("growth"))


LONGS = {
    "momentum": ("up", "1", "true"), "momentum_vol": ("CASE WHEN vol > 0 THEN up END", "1 / vol", "true"), "trend_momentum": ("CASE WHEN close > mean THEN up END", "1", "true"), "regime_momentum": ("up", "1", "coalesce(lc > lm, false)"),
    "strong_regime_momentum": ("up", "1", "coalesce(lc > 1.05 * lm, false)"), "regime_long_short": ("up", "1", "coalesce(lc > lm, false)"), "cash_gate": ("up", "1", "NOT coalesce(lc < lm AND lu < 0, false)"),
    "breadth_cash_gate": ("up", "1", "NOT coalesce(lc < lm AND ls < 0 AND br >= 0.7, false)"), "reversal": ("-ups", "1", "true"),
}
SHORTS = {"bear_short": "coalesce(lc < lm, false)", "regime_long_short": "NOT coalesce(lc > lm, false)"}
RULE_ROWS = " UNION ALL ".join([f"SELECT '{n}' AS rule, d, asset, {score} AS score, ({size})::DOUBLE AS size, 1 AS sgn FROM m WHERE {gate}" for n, (score, size, gate) in LONGS.items()] + [f"SELECT '{n}', d, asset, -up, 1.0::DOUBLE, -1 FROM m WHERE {gate}" for n, gate in SHORTS.items()])


@query("c13_rules", f"""WITH {L.WEEKLY}, pc AS (SELECT dense_rank() OVER (ORDER BY week) - 1 AS d, symbol AS asset, close FROM wk),
sc AS (SELECT p.d, p.asset, p.close, p.close / a.close - 1 AS up, p.close / s.close - 1 AS ups, p.close / o.close - 1 AS one FROM pc p LEFT JOIN pc a ON a.asset = p.asset AND a.d = p.d - 8 LEFT JOIN pc s ON s.asset = p.asset AND s.d = p.d - 2 LEFT JOIN pc o ON o.asset = p.asset AND o.d = p.d - 1),
sv AS (SELECT *, avg(close) OVER (PARTITION BY asset ORDER BY d RANGE BETWEEN 25 PRECEDING AND CURRENT ROW) AS mean, stddev_pop(one) OVER (PARTITION BY asset ORDER BY d RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS vol FROM sc),
ld AS (SELECT d, close AS lc, mean AS lm, up AS lu, ups AS ls FROM sv WHERE asset = 'NATION_0'), bd AS (SELECT d, count(*) FILTER (up < 0) / nullif(count(up), 0)::DOUBLE AS br FROM sv GROUP BY 1),
m AS (SELECT sv.*, lc, lm, lu, ls, br FROM sv LEFT JOIN ld USING (d) JOIN bd USING (d)), rw AS ({RULE_ROWS}),
ch AS (SELECT * FROM rw WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rule, d, sgn ORDER BY score DESC, asset) <= 5),
hw AS (SELECT rule, d, asset, sgn * size / sum(size) OVER (PARTITION BY rule, d) AS w FROM ch UNION ALL SELECT 'equal_weight', d, asset, 1.0::DOUBLE / (SELECT count(DISTINCT asset) FROM pc) FROM (SELECT DISTINCT d FROM pc), (SELECT DISTINCT asset FROM pc)),
cw AS (SELECT rule, (d - 26) // 4 AS reb, asset, w FROM hw WHERE d >= 26 AND (d - 26) % 4 = 0), cal AS (SELECT rule, d, (d - 26) // 4 AS reb FROM (SELECT unnest(range(26, (SELECT max(d) FROM pc))) AS d), (SELECT DISTINCT rule FROM hw)),
er AS (SELECT c.rule, p.d, sum(c.w) AS active, sum(c.w * (n.close / p.close - 1)) AS got FROM pc p JOIN pc n ON n.asset = p.asset AND n.d = p.d + 1 JOIN cw c ON c.asset = p.asset AND c.reb = (p.d - 26) // 4 AND p.d >= 26 GROUP BY 1, 2),
tv AS (SELECT coalesce(a.rule, b.rule) AS rule, coalesce(a.reb, b.reb + 1) AS reb, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS t FROM cw a FULL JOIN cw b ON a.rule = b.rule AND a.asset = b.asset AND a.reb = b.reb + 1 GROUP BY 1, 2),
rn AS (SELECT cal.rule, cal.d, CASE WHEN active > 1e-12 THEN got / active ELSE 0 END AS ret, CASE WHEN (cal.d - 26) % 4 = 0 THEN coalesce(t, 0) ELSE 0 END AS turnover FROM cal LEFT JOIN er USING (rule, d) LEFT JOIN tv ON tv.rule = cal.rule AND tv.reb = cal.reb),
eq AS (SELECT *, exp(sum(ln((1 - turnover * 0.009) * (1 + ret))) OVER (PARTITION BY rule ORDER BY d)) AS equity FROM rn), fl AS (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY rule ORDER BY d)) - 1 AS fall FROM eq),
ag AS (SELECT rule, count(*) AS dates, arg_max(equity, d) AS final, stddev_pop(ret) * sqrt(52) AS volatility, least(0, min(fall)) AS drawdown, sum(turnover) AS turnover, avg(ret) AS average FROM fl GROUP BY 1)
SELECT rule, dates, round(ln(final), 5) AS growth, round(volatility, 6) AS volatility, round(drawdown, 6) AS drawdown, round(turnover, 6) AS turnover, round(average, 6) AS average, round(CASE WHEN volatility > 0 THEN (pow(final, 52.0 / dates) - 1) / volatility ELSE 0 END, 5) AS sharpe FROM ag""")
def _(spark, sf):
    """Eleven rules on weekly closes, rebalanced every fourth week, with their figures."""
    weeks = L.weekly(spark, sf)
    index = weeks.select("week").distinct().withColumn("d", F.row_number().over(Window.orderBy("week")) - 1)
    prices = weeks.join(F.broadcast(index), "week").select("d", F.col("symbol").alias("asset"), "close")
    held = W.weights(W.scored(prices, "NATION_0", 8, 2, 26))
    found = W.figures(W.portfolio_runs(prices, held, 26, 4), 0.009, 52)
    return found.select("rule", "dates", F.round(F.log1p("total"), 5).alias("growth"), *(r6(c).alias(c) for c in ("volatility", "drawdown", "turnover", "average")), F.round("sharpe", 5).alias("sharpe"))


@query("c3_post_only", f"{B60} SELECT symbol, time, k, coalesce(CASE WHEN k % 2 = 0 THEN open + k - 3 >= high ELSE open + k - 3 <= low END, false) AS rejected FROM b, (SELECT unnest(range(7)) AS k)")
def _(spark, sf):
    """Limit orders around the open, bought at even steps: high and low stand for the best ask and bid."""
    orders = L.bars(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    side = F.when(F.col("k") % 2 == 0, "buy").otherwise("sell")
    return orders.select("symbol", "time", "k", C.post_only_rejected(side, F.col("open") + F.col("k") - 3, F.col("low"), F.col("high")).alias("rejected"))


@query("c7_commission_floor", f"{B60}, t AS (SELECT symbol, lag(close) OVER s / 10 AS entry, close / 10 AS px FROM b{S}), z AS (SELECT symbol, usd, floor(usd / entry) AS shares, (px - entry) / 2.0 AS r FROM t, (SELECT unnest([100.0, 200.0, 500.0, 1000.0, 5000.0]::DOUBLE[]) AS usd) WHERE entry IS NOT NULL) SELECT symbol, usd, count(*) FILTER (shares >= 1) AS trades, count(*) FILTER (shares < 1) AS too_small, round(avg(r - 2 * greatest(shares * 0.005, 1) / (shares * 2.0)) FILTER (shares >= 1), 6) AS net FROM z GROUP BY 1, 2")
def _(spark, sf):
    trades = L.bars(spark, sf).select("symbol", (F.lag("close").over(I.by_time()) / 10).alias("entry"), (F.col("close") / 10).alias("px")).filter("entry is not null").select("symbol", "entry", F.lit(2.0).alias("risk"), ((F.col("px") - F.col("entry")) / 2.0).alias("r"))
    return rounded(C.commission_floor(trades, [100.0, 200.0, 500.0, 1000.0, 5000.0], keys=("symbol",)), "net")


@query("a21_open_positions", f"{BREAK}, lt AS (SELECT symbol, arg_max(close, time) AS price FROM b GROUP BY 1) SELECT symbol, count(*) AS positions, round(sum((price - close) * volume - (close + price) * volume * 0.0025), 4) AS unrealized, round(avg(CASE WHEN pa > 0 THEN (price - close) / (2 * pa) ELSE 0 END), 6) AS mean_r FROM k JOIN lt USING (symbol) WHERE close > don AND pa IS NOT NULL GROUP BY 1")
def _(spark, sf):
    """Breakouts held to the last close: what closing them now would give, and their multiple of the risk."""
    bars = L.bars(spark, sf)
    last = bars.groupBy("symbol").agg(F.max_by("close", "time").alias("price"))
    held = breakouts(bars).filter("before is not null").select("symbol", F.col("close").alias("entry"), "volume", (2 * F.col("before")).alias("risk"))
    found = C.open_positions(held.join(F.broadcast(last), "symbol"), 0.0025)
    return found.groupBy("symbol").agg(F.count("*").alias("positions"), F.round(F.sum("pnl"), 4).alias("unrealized"), r6(F.avg("r")).alias("mean_r"))


@query("c17_exposure", f"{B60}, h AS (SELECT symbol, time, close, CASE WHEN coalesce({full(f'close > avg(close) {over(-19, 0)}', 'close', -19, 0)}, false) THEN 1 ELSE 0 END AS st FROM b), g AS (SELECT symbol, time, coalesce(lag(st) OVER s, 0) AS held, coalesce(close / lag(close) OVER s - 1, 0) AS ret FROM h{S}), f AS (SELECT *, abs(held - coalesce(lag(held) OVER s, 0)) AS flip FROM g{S}) SELECT symbol, sum(flip)::BIGINT AS flips, round(exp(sum(ln(1 + held * ret) + flip * ln(0.999::DOUBLE))), 6) AS growth, round(exp(sum(ln(1 + ret)) + 2 * ln(0.999::DOUBLE)), 6) AS hold FROM f GROUP BY 1")
def _(spark, sf):
    bars = L.bars(spark, sf).withColumn("ma", I.sma("close", 20))
    return rounded(C.exposure(bars, F.col("close") > F.col("ma"), 0.001), "growth", "hold")


@query("c18_risk_size", f"{BREAK} SELECT symbol, time, round(least(2000.0, 50.0 / (2 * pa / close)), 5) AS money FROM k WHERE close > don AND pa > 0")
def _(spark, sf):
    found = breakouts(L.bars(spark, sf)).filter("before > 0")
    return found.select("symbol", "time", F.round(C.risk_size(10_000.0, (F.col("close") - F.col("stop")) / F.col("close")), 5).alias("money"))


@query("c19_rotation", f"{MOVES}, z AS (SELECT symbol, time, sum(r) {RUN} AS up FROM y) SELECT time, arg_max(symbol, (up, symbol)) AS best, max(up) AS up FROM z GROUP BY 1")
def _(spark, sf):
    up = moves(spark, sf).select("symbol", "time", F.sum("r").over(C.running("symbol")).alias("up"))
    return up.groupBy("time").agg(F.max_by("symbol", F.struct("up", "symbol")).alias("best"), F.max("up").alias("up"))


DATES = f"{PANEL}, dm AS (SELECT date, avg(fwd) AS m FROM pn GROUP BY 1)"
REPLICAS = "(SELECT unnest(range(1, {0})) AS replica)"


def date_means(spark, sf):
    return panel(spark, sf).groupBy("date").agg(F.avg("fwd").alias("m"))


@query("i2_shuffled_assets", f"""{PANEL}, o AS (SELECT avg(c) AS ic FROM (SELECT corr(trail, fwd) AS c FROM pn GROUP BY date) WHERE NOT isnan(c)), l AS (SELECT date, trail, row_number() OVER (PARTITION BY date ORDER BY asset) AS spot FROM pn),
x AS (SELECT replica, date, fwd, row_number() OVER (PARTITION BY replica, date ORDER BY md5(concat_ws('|', 'p', replica, date, asset))) AS spot FROM pn, {REPLICAS.format(1001)}),
d AS (SELECT replica, avg(c) AS r FROM (SELECT replica, date, corr(trail, fwd) AS c FROM x JOIN l USING (date, spot) GROUP BY 1, 2) WHERE NOT isnan(c) GROUP BY 1) SELECT round(any_value(ic), 6) AS ic, (count(*) FILTER (r >= ic) + 1) / 1001.0::DOUBLE AS p FROM d, o""")
def _(spark, sf):
    return rounded(R.permuted_ic(panel(spark, sf), 1000), "ic")


@query("i4_bootstrap", f"""{DATES}, nm AS (SELECT row_number() OVER (ORDER BY date) - 1 AS spot, m FROM dm), x AS (SELECT replica, ('0x' || substr(md5(concat_ws('|', 'b', replica, spot)), 1, 8))::BIGINT % (SELECT count(*) FROM nm) AS spot FROM nm, {REPLICAS.format(1001)}),
e AS (SELECT replica, avg(m) AS m FROM x JOIN nm USING (spot) GROUP BY 1), k AS (SELECT m, row_number() OVER (ORDER BY m, replica) - 1 AS k FROM e) SELECT round(max(m) FILTER (k = 25), 6) AS lo, round(max(m) FILTER (k = 975), 6) AS hi FROM k""")
def _(spark, sf):
    return rounded(R.bootstrap_interval(date_means(spark, sf), "m", "date", 1000), "lo", "hi")


@query("i4_block_bootstrap", f"""{DATES}, nm AS (SELECT row_number() OVER (ORDER BY date) - 1 AS spot, m FROM dm), x AS (SELECT replica, ('0x' || substr(md5(concat_ws('|', 'b', replica, spot // 4)), 1, 8))::BIGINT % (SELECT count(*) - 3 FROM nm) + spot % 4 AS spot FROM nm, {REPLICAS.format(1001)}),
e AS (SELECT replica, avg(m) AS m FROM x JOIN nm USING (spot) GROUP BY 1), k AS (SELECT m, row_number() OVER (ORDER BY m, replica) - 1 AS k FROM e) SELECT round(max(m) FILTER (k = 25), 6) AS lo, round(max(m) FILTER (k = 975), 6) AS hi FROM k""")
def _(spark, sf):
    return rounded(R.bootstrap_interval(date_means(spark, sf), "m", "date", 1000, block=4), "lo", "hi")


@query("i10_sign_flip", f"""{DATES}, x AS (SELECT replica, avg(CASE WHEN substr(md5(concat_ws('|', 's', replica, date)), 1, 1) < '8' THEN m ELSE -m END) AS r FROM dm, {REPLICAS.format(5001)} GROUP BY 1) SELECT (SELECT count(*) FROM dm) AS n, (SELECT round(avg(m), 6) FROM dm) AS mean, (count(*) FILTER (r >= (SELECT avg(m) FROM dm)) + 1) / 5001.0::DOUBLE AS p FROM x""")
def _(spark, sf):
    return rounded(R.sign_flip(date_means(spark, sf), "m", "date", 5000), "mean")


@query("i2_permutation")
def _(spark, sf):
    """Whole panels paired anew across dates, asset by asset, 1000 times."""
    return rounded(R.permuted_panels(panel(spark, sf), 1000), "ic")


@query("i3_date_vectors")
def _(spark, sf):
    """Whole forward vectors moved to other dates, by place, 1000 times, two-sided."""
    return rounded(R.permuted_vectors(panel(spark, sf), 1000), "ic")


@query("i8_block_permuted_ic")
def _(spark, sf):
    """Rank correlation of the flow and the next six hours' change per symbol, blocks of six hours permuted 300 times."""
    bars = L.bars(spark, sf)
    rows = bars.select("symbol", "time", (F.col("buy_vol") - F.col("sell_vol")).alias("x"), (F.lead("close", 6).over(I.by_time()) / F.col("close") - 1).alias("y")).filter("y is not null")
    return rounded(R.block_permuted_ic(rows, 6, 300), "ic")


@query("i11_anova_p", f"""{MOVES}, yy AS (SELECT symbol, time, r FROM y WHERE r IS NOT NULL), o AS (SELECT symbol, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM yy GROUP BY 1), w AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM o), bd AS (SELECT n AS size, (sum(n) OVER (ORDER BY symbol) - n)::BIGINT AS lo, (sum(n) OVER (ORDER BY symbol))::BIGINT AS hi FROM o),
dx AS (SELECT replica, r, row_number() OVER (PARTITION BY replica ORDER BY md5(concat_ws('|', 'a', replica, symbol, time)), symbol, time) - 1 AS place FROM yy, {REPLICAS.format(1001)}), g AS (SELECT replica, lo, size, sum(r) AS s FROM dx JOIN bd ON place >= lo AND place < hi GROUP BY ALL), rr AS (SELECT replica, sum(s * s / size) AS r FROM g GROUP BY 1)
SELECT round(any_value(((b - w.s * w.s / w.n) / (k - 1)) / ((q - b) / (w.n - k))), 5) AS f, (count(*) FILTER (r >= b - 1e-9) + 1) / 1001.0::DOUBLE AS p FROM rr, w""")
def _(spark, sf):
    """Do the symbols' changes differ: f, and its p under permuted symbols."""
    return R.permuted_anova(moves(spark, sf), "r", "symbol", ["symbol", "time"], 1000).withColumn("f", F.round("f", 5))


@query("i13_dickey_fuller", f"{B60}, c AS (SELECT symbol, time, close, close - lag(close) OVER s AS d, lag(close) OVER s AS e FROM b{S}), c2 AS (SELECT *, lag(d) OVER s AS d1 FROM c{S}), g AS (SELECT symbol, count(*) AS n, covar_pop(e, e) AS ee, covar_pop(d1, d1) AS dd, covar_pop(e, d1) AS ed, covar_pop(e, d) AS ey, covar_pop(d1, d) AS dy, covar_pop(d, d) AS yy FROM c2 WHERE d1 IS NOT NULL GROUP BY 1), h AS (SELECT *, ee * dd - ed * ed AS f, (ey * dd - dy * ed) / (ee * dd - ed * ed) AS rho, (dy * ee - ey * ed) / (ee * dd - ed * ed) AS phi FROM g) SELECT symbol, n, round(rho, 6) AS rho, round(rho / sqrt((n * (yy - rho * ey - phi * dy)) / (n - 3) * dd / (n * f)), 5) AS t FROM h")
def _(spark, sf):
    found = R.dickey_fuller(L.bars(spark, sf), "close", "symbol")
    return found.select("symbol", "n", r6("rho").alias("rho"), F.round("t", 5).alias("t"))


@query("i13_half_life", f"{B60}, c AS (SELECT symbol, close - lag(close) OVER s AS d, lag(close) OVER s AS e FROM b{S}), g AS (SELECT symbol, regr_slope(d, e) AS slope FROM c WHERE e IS NOT NULL GROUP BY 1) SELECT symbol, round(slope, 6) AS slope, round(CASE WHEN slope > -1 AND slope < 0 THEN ln(0.5::DOUBLE) / ln(1 + slope) END, 3) AS periods FROM g")
def _(spark, sf):
    steps = L.bars(spark, sf).select("symbol", (F.col("close") - F.lag("close").over(I.by_time())).alias("d"), F.lag("close").over(I.by_time()).alias("e")).filter("e is not null")
    return steps.groupBy("symbol").agg(F.regr_slope(F.col("d"), F.col("e")).alias("slope")).select("symbol", r6("slope").alias("slope"), F.round(R.half_life(F.col("slope")), 3).alias("periods"))


@query("i14_pairs", f"""WITH {L.WEEKLY}, p AS (SELECT a.symbol AS one, c.symbol AS other, a.week, ln(a.close) AS y, ln(c.close) AS x FROM wk a JOIN wk c ON a.week = c.week AND a.symbol < c.symbol),
f AS (SELECT one, other, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM p GROUP BY 1, 2), e AS (SELECT one, other, beta, week, y - alpha - beta * x AS e FROM p JOIN f USING (one, other)), g AS (SELECT one, other, beta, e - lag(e) OVER w AS d, lag(e) OVER w AS e0 FROM e WINDOW w AS (PARTITION BY one, other ORDER BY week))
SELECT one, other, round(any_value(beta), 5) AS beta, round(regr_slope(d, e0), 5) AS slope FROM g WHERE e0 IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    """Hedge ratio of every pair and the pull of its spread back to the mean."""
    weeks = L.weekly(spark, sf)
    a, b = (weeks.select("week", F.col("symbol").alias(s), F.log("close").alias(c)) for s, c in (("one", "y"), ("other", "x")))
    pairs = a.join(b, "week").filter("one < other")
    fit = pairs.groupBy("one", "other").agg(F.regr_slope(F.col("y"), F.col("x")).alias("beta"), F.regr_intercept(F.col("y"), F.col("x")).alias("alpha"))
    spread = pairs.join(fit, ["one", "other"]).withColumn("e", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"))
    w = Window.partitionBy("one", "other").orderBy("week")
    steps = spread.select("one", "other", "beta", (F.col("e") - F.lag("e").over(w)).alias("d"), F.lag("e").over(w).alias("e0")).filter("e0 is not null")
    return steps.groupBy("one", "other").agg(F.round(F.first("beta"), 5).alias("beta"), F.round(F.regr_slope(F.col("d"), F.col("e0")), 5).alias("slope"))


FEATURES = ["flow", "rel", "pos"]


def labelled(spark, sf):
    """symbol, time, y (the next close is higher), three features, train (before 70 % of the time)."""
    bars = L.bars(spark, sf)
    rows = bars.select("symbol", "time", (F.lead("close").over(I.by_time()) > F.col("close")).cast("int").alias("y"), ((F.col("buy_vol") - F.col("sell_vol")) / F.nullif(F.col("volume"), F.lit(0.0))).alias("flow"), I.relative("volume", 20).alias("rel"), I.range_position().alias("pos")).filter("y is not null")
    cut = bars.agg((F.min("time") + (F.max("time") - F.min("time")) * 0.7).alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("train", F.col("time") < F.col("cut")).drop("cut")


FEATURED = f"""{B60}, ft AS (SELECT symbol, time, CASE WHEN lead(close) OVER s > close THEN 1 WHEN lead(close) OVER s IS NOT NULL THEN 0 END AS y, coalesce((buy_vol - sell_vol) / nullif(volume, 0), 0) AS flow, time < (SELECT min(time) + (max(time) - min(time)) * 0.7::DOUBLE FROM b) AS train FROM b{S}), fy AS (SELECT * FROM ft WHERE y IS NOT NULL)"""


@query("m1_encoded", f"{B60} SELECT symbol, time, coalesce((buy_vol - sell_vol) / nullif(volume, 0), 0) AS flow, CASE WHEN close > open THEN 1.0::DOUBLE ELSE 0 END AS up, CASE WHEN time // 3600 % 24 // 8 = 0 THEN 1.0::DOUBLE ELSE 0 END AS session_asia, CASE WHEN time // 3600 % 24 // 8 = 1 THEN 1.0::DOUBLE ELSE 0 END AS session_europe FROM b")
def _(spark, sf):
    """Numbers, booleans and a category as columns of doubles."""
    hour = F.floor(F.col("time") / 3600) % 24
    rows = L.bars(spark, sf).select("symbol", "time", ((F.col("buy_vol") - F.col("sell_vol")) / F.nullif(F.col("volume"), F.lit(0.0))).alias("flow"), (F.col("close") > F.col("open")).alias("up"), F.when(hour < 8, "asia").when(hour < 16, "europe").otherwise("us").alias("session"))
    return M.encoded(rows, ["flow", "up"], {"session": ["asia", "europe"]})


@query("m9_funding_feature", f"{B60}, f AS (SELECT symbol, time // 28800 * 28800 + 28800 AS time, sum(buy_vol - sell_vol) AS rate FROM b WHERE time // 28800 % 3 <> 1 GROUP BY 1, 2) SELECT b.symbol, b.time, f.rate FROM b ASOF JOIN f ON f.symbol = b.symbol AND b.time >= f.time")
def _(spark, sf):
    """The flow of the last known eight hours as of each hour, only where one is known."""
    bars = L.bars(spark, sf)
    part = F.floor(F.col("time") / 28800)
    rates = bars.filter(part % 3 != 1).groupBy("symbol", (part * 28800 + 28800).alias("time")).agg(F.sum(F.col("buy_vol") - F.col("sell_vol")).alias("rate"))
    return J.as_of(bars.select("symbol", "time"), rates, "rate").filter("rate is not null")


@query("m2_standardised", f"{FEATURED} SELECT symbol, time, round((flow - (SELECT avg(flow) FROM fy WHERE train)) / (SELECT stddev_pop(flow) FROM fy WHERE train), 6) AS flow FROM fy")
def _(spark, sf):
    return rounded(M.standardised(labelled(spark, sf), ["flow"], "train").select("symbol", "time", "flow"), "flow")


@query("m3_class_weights", f"{FEATURED}, c AS (SELECT y, count(*) AS n_class FROM fy WHERE train GROUP BY 1) SELECT y, n_class, round((SELECT sum(n_class) FROM c) / (2 * n_class), 6) AS weight FROM c")
def _(spark, sf):
    return rounded(M.class_weights(labelled(spark, sf).filter("train"), "y"), "weight")


@query("m5_auc", f"{FEATURED}, o AS (SELECT symbol, y, rank() OVER (PARTITION BY symbol ORDER BY flow) + (count(*) OVER (PARTITION BY symbol, flow) - 1) / 2.0 AS k FROM fy) SELECT symbol, round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS auc FROM o GROUP BY 1")
def _(spark, sf):
    rows = labelled(spark, sf).withColumn("flow", F.coalesce("flow", F.lit(0.0)))
    return rounded(M.auc(rows, "flow", "y", "symbol"), "auc")


@query("m8_precision", f"{FEATURED} SELECT symbol, count(*) FILTER (flow > 0.1 AND y = 1) / nullif(count(*) FILTER (flow > 0.1), 0)::DOUBLE AS precision, count(*) FILTER (flow > 0.1 AND y = 1) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE AS recall FROM fy GROUP BY 1")
def _(spark, sf):
    said, true = F.coalesce("flow", F.lit(0.0)) > 0.1, F.col("y") == 1
    hit = F.count_if(said & true)
    return labelled(spark, sf).groupBy("symbol").agg((hit / F.nullif(F.count_if(said), F.lit(0))).alias("precision"), (hit / F.nullif(F.count_if(true), F.lit(0))).alias("recall"))


@query("m4_classifier")
def _(spark, sf):
    """Area under the curve of a fitted classifier on training and later rows."""
    scored = M.fit_and_score(labelled(spark, sf), FEATURES, "y", "train", 0.01)
    return M.auc(scored, "score", "y", "train")


PENALTIES = [0.0, 0.01, 0.1, 1.0]


def keyed(spark, sf):
    """Labelled rows with a key in the order of time, and the day."""
    rows = labelled(spark, sf)
    return rows.withColumns({"key": F.concat_ws("/", F.lpad(F.col("time").cast("string"), 12, "0"), "symbol"), "day": F.floor(F.col("time") / 86400)})


@query("m6_penalty_choice")
def _(spark, sf):
    """Penalties on three stratified folds of the training rows, ranked by area, loss and size."""
    rows = M.standardised(keyed(spark, sf), FEATURES, "train").filter("train").withColumns({"x": F.array(*FEATURES), "ys": F.array("y")})
    found = M.choose_penalties(M.stratified_folds(rows, "y", "key", "day", 3), [0], PENALTIES, 3)
    return rounded(found.select("penalty", "mean_auc", "mean_loss", "place"), "mean_auc", "mean_loss")


@query("m7_sealed_score")
def _(spark, sf):
    """Held-out area of the chosen model, and its p under 100 refits with permuted training labels."""
    return rounded(M.sealed_score(keyed(spark, sf), FEATURES, "key", "y", "train", "day", PENALTIES), "train_auc", "holdout_auc", "p")
