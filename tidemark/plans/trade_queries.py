"""Pivots, entry rules and simulated positions. Stateful results are checked by recursive SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.operators import entries as E
from tidemark.operators import indicators as I
from tidemark.operators import joins as J
from tidemark.operators import pivots as P
from tidemark.operators import positions as X
from tidemark.plans import lenses as L
from tidemark.plans.bar_queries import ATR, S, TR, full, over
from tidemark.plans.base import Catalog, r6, rounded
from tidemark.sources.tables import settled

catalog = Catalog()
query = catalog.query

PIVOTS = f"""WITH RECURSIVE {L.BARS},
nb AS MATERIALIZED (SELECT *, row_number() OVER s - 1 AS i, coalesce({full(f'low < min(low) {over(-5, -1)}', 'low', -5, -1)}, false) AS ll, coalesce({full(f'high > max(high) {over(-5, -1)}', 'high', -5, -1)}, false) AS lh FROM b{S}),
st AS (
  SELECT symbol, i, NULL::BIGINT AS li, NULL::DOUBLE AS lp, NULL::DOUBLE AS lt, NULL::BIGINT AS hi, NULL::DOUBLE AS hp, NULL::DOUBLE AS ht, NULL::VARCHAR AS kind, NULL::BIGINT AS pivot_i, NULL::DOUBLE AS pivot_price, NULL::BIGINT AS cand_i FROM nb WHERE i = 0
  UNION ALL
  SELECT symbol, i, CASE WHEN pv IS NULL THEN li END, CASE WHEN pv IS NULL THEN lp END, CASE WHEN pv IS NULL THEN lt END, CASE WHEN pv IS NULL THEN hi END, CASE WHEN pv IS NULL THEN hp END, CASE WHEN pv IS NULL THEN ht END,
    pv, CASE pv WHEN 'low' THEN li WHEN 'high' THEN hi END, CASE pv WHEN 'low' THEN lp WHEN 'high' THEN hp END, was
  FROM (SELECT *, CASE WHEN li < i AND close > lt THEN 'low' WHEN hi < i AND close < ht THEN 'high' END AS pv FROM (
    SELECT n.symbol, n.i, n.close, st.li AS was, CASE WHEN n.ll AND (st.lp IS NULL OR n.low < st.lp) THEN n.i ELSE st.li END AS li, CASE WHEN n.ll AND (st.lp IS NULL OR n.low < st.lp) THEN n.low ELSE st.lp END AS lp,
      CASE WHEN n.ll AND (st.lp IS NULL OR n.low < st.lp) THEN n.high ELSE st.lt END AS lt, CASE WHEN n.lh AND (st.hp IS NULL OR n.high > st.hp) THEN n.i ELSE st.hi END AS hi,
      CASE WHEN n.lh AND (st.hp IS NULL OR n.high > st.hp) THEN n.high ELSE st.hp END AS hp, CASE WHEN n.lh AND (st.hp IS NULL OR n.high > st.hp) THEN n.low ELSE st.ht END AS ht
    FROM st JOIN nb n ON n.symbol = st.symbol AND n.i = st.i + 1)))"""
LAST = "last_value({0} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"


@query("p1_pivots", f"{PIVOTS} SELECT symbol, i, kind, pivot_i, pivot_price FROM st WHERE kind IS NOT NULL")
def _(spark, sf):
    return P.with_pivots(L.bars(spark, sf)).filter("pivot is not null").select("symbol", "i", F.col("pivot").alias("kind"), "pivot_i", "pivot_price")


@query("p2_bias", f"{PIVOTS} SELECT symbol, i, CASE {LAST.format('kind')} WHEN 'low' THEN 'bull' WHEN 'high' THEN 'bear' END AS bias FROM st")
def _(spark, sf):
    return P.with_bias(P.with_pivots(L.bars(spark, sf))).select("symbol", "i", "bias")


@query("p3_pending_low", f"{PIVOTS} SELECT symbol, i, cand_i FROM st WHERE i - cand_i <= 48")
def _(spark, sf):
    return P.with_pivots(L.bars(spark, sf)).filter("i - cand_i <= 48").select("symbol", "i", "cand_i")


@query("p4_entry_signal", f"{PIVOTS}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS k FROM st WHERE kind IS NOT NULL), m AS (SELECT symbol, max(i) AS last FROM st GROUP BY 1) SELECT symbol, kind, i, kind = 'low' AND last - i <= 16 AS signal FROM o JOIN m USING (symbol) WHERE k = 1")
def _(spark, sf):
    state = P.with_pivots(L.bars(spark, sf))
    found = state.groupBy("symbol").agg(F.max("i").alias("last"), F.max_by("pivot", F.when(F.col("pivot").isNotNull(), F.col("i"))).alias("pivot"), F.max(F.when(F.col("pivot").isNotNull(), F.col("i"))).alias("i"))
    return found.filter("pivot is not null").select("symbol", F.col("pivot").alias("kind"), "i", ((F.col("pivot") == "low") & (F.col("last") - F.col("i") <= 16)).alias("signal"))


@query("p5_trend", f"{PIVOTS}, r AS (SELECT symbol, i, kind, CASE WHEN kind IS NOT NULL THEN coalesce(pivot_price > lag(pivot_price) OVER (PARTITION BY symbol, kind ORDER BY i), false) END AS up FROM st) SELECT symbol, i, coalesce({LAST.format(chr(40) + 'CASE WHEN kind = ' + chr(39) + 'low' + chr(39) + ' THEN up END' + chr(41))}, false) AND coalesce({LAST.format(chr(40) + 'CASE WHEN kind = ' + chr(39) + 'high' + chr(39) + ' THEN up END' + chr(41))}, false) AS trend FROM r")
def _(spark, sf):
    return P.with_trend(P.with_pivots(L.bars(spark, sf))).select("symbol", "i", "trend")


BIAS4 = L.coarse("b", 240)


@query("j4_higher_bias", PIVOTS.replace(L.coarse(), BIAS4) + f", v AS (SELECT nb.symbol, nb.time + 14400 AS time, CASE st.kind WHEN 'low' THEN 'bull' ELSE 'bear' END AS bias FROM st JOIN nb USING (symbol, i) WHERE st.kind IS NOT NULL){L.coarse('h1')} SELECT h1.symbol, h1.time, v.bias FROM h1 ASOF LEFT JOIN v ON h1.symbol = v.symbol AND h1.time + 3600 >= v.time")
def _(spark, sf):
    """The 4-hour bias as of the close of each hour."""
    higher = P.with_pivots(L.bars(spark, sf, 240)).filter("pivot is not null")
    flips = higher.select("symbol", (F.col("time") + 14400).alias("time"), F.when(F.col("pivot") == "low", "bull").otherwise("bear").alias("bias"))
    hours = L.bars(spark, sf).select("symbol", (F.col("time") + 3600).alias("time"))
    return J.as_of(hours, flips, "bias").select("symbol", (F.col("time") - 3600).alias("time"), "bias")


@query("j5_resistance", f"{PIVOTS}, hs AS (SELECT symbol, i AS at, pivot_price AS p FROM st WHERE kind = 'high') SELECT nb.symbol, nb.i, min(hs.p) AS resistance FROM nb LEFT JOIN hs ON hs.symbol = nb.symbol AND hs.at < nb.i AND hs.p > nb.close GROUP BY 1, 2")
def _(spark, sf):
    """The lowest confirmed high above the close of every bar."""
    return P.with_resistance(P.with_pivots(L.bars(spark, sf)))


@query("j6_support_touch", f"{PIVOTS}, ls AS (SELECT symbol, i AS at, pivot_price AS p FROM st WHERE kind = 'low') SELECT nb.symbol, nb.i, arg_min(ls.p, (abs(nb.low - ls.p), ls.at)) AS support FROM nb JOIN ls ON ls.symbol = nb.symbol AND ls.at < nb.i AND nb.low BETWEEN 0.98 * ls.p AND 1.004 * ls.p GROUP BY 1, 2")
def _(spark, sf):
    return P.touched_support(P.with_pivots(L.bars(spark, sf)))


RSI = f"""WITH RECURSIVE {L.BARS}, mv AS MATERIALIZED (SELECT symbol, time, row_number() OVER s - 1 AS i, greatest(close - lag(close) OVER s, 0) AS g, greatest(lag(close) OVER s - close, 0) AS l FROM b{S}),
rs AS (SELECT symbol, 14::BIGINT AS i, avg(g) AS up, avg(l) AS down FROM mv WHERE i BETWEEN 1 AND 14 GROUP BY 1 HAVING count(*) = 14
  UNION ALL SELECT m.symbol, m.i, (rs.up * 13 + m.g) / 14, (rs.down * 13 + m.l) / 14 FROM rs JOIN mv m ON m.symbol = rs.symbol AND m.i = rs.i + 1),
ri AS (SELECT mv.symbol, mv.time, mv.i, CASE WHEN rs.down = 0 THEN 100 WHEN rs.up IS NOT NULL THEN 100 - 100 / (1 + rs.up / rs.down) END AS rsi FROM mv LEFT JOIN rs USING (symbol, i))"""


@query("w5_rsi", f"{RSI} SELECT symbol, time, round(rsi, 5) AS rsi FROM ri")
def _(spark, sf):
    return P.wilder_rsi(L.bars(spark, sf)).withColumn("rsi", F.round("rsi", 5))


PREP = f"""WITH {L.BARS}, t AS (SELECT *, row_number() OVER s - 1 AS i, lag(close) OVER s AS pc, CASE WHEN lag(close) OVER s IS NOT NULL THEN {TR} END AS tr FROM b{S}),
u AS (SELECT *, {ATR} AS atr, {full(f'avg(close) {over(-19, 0)}', 'close', -19, 0)} AS s20, {full(f'avg(close) {over(-49, 0)}', 'close', -49, 0)} AS s50, {full(f'max(high) {over(-20, -1)}', 'high', -20, -1)} AS don,
  {full(f'min(low) {over(-12, -1)}', 'low', -12, -1)} AS l12, {full(f'min(low) {over(-24, -1)}', 'low', -24, -1)} AS l24, min(low) {over(-5, 0)} AS l6, avg(volume) {over(-20, -1)} AS v20, list(low) {over(-20, -1)} AS lows FROM t),
k AS (SELECT *, lag(atr) OVER s AS pa, lag(s20) OVER s AS ps20 FROM u{S})"""
RULES = {
    "ma_dip": ("close < 0.98 * s20", "low * 0.999"),
    "breakout": ("close > don", "close - 2 * pa"),
    "trend_pullback": ("s20 > s50 AND pc <= ps20 AND close > s20", "l6 * 0.999"),
    "sweep_reclaim": ("low < l12 AND close > l12 AND close > open", "low - 0.25 * pa"),
    "range_sweep_reclaim": ("i >= 50 AND low < l24 AND close > l24 AND abs(s20 / s50 - 1) <= 0.02 AND volume >= 1.2 * v20 AND len([x FOR x IN lows IF x <= 1.005 * l24]) >= 2", "low - 0.25 * pa"),
}
REASON = "CASE WHEN stop >= close THEN 'price_below_stop' WHEN (close - stop) / close > 0.06 THEN 'stop_too_far' WHEN (close - stop) / close < 0.01 THEN 'stop_too_tight' ELSE 'taken' END"


def _entry_query(mode: str):
    when, stop = RULES[mode]

    @query(f"e_{mode}", f"{PREP}, c AS (SELECT symbol, i, close, {stop} AS stop FROM k WHERE {when}) SELECT symbol, i, close AS entry, round(stop, 6) AS stop, {REASON} AS reason FROM c WHERE stop IS NOT NULL")
    def _(spark, sf):
        found = E.candidates(E.prepared(L.bars(spark, sf)), mode)
        return rounded(found.select("symbol", "i", "entry", "stop", "reason"), "stop")


for _mode in RULES:
    _entry_query(_mode)


@query("e_bos", f"{PIVOTS} SELECT st.symbol, st.i, nb.close AS entry, st.pivot_price AS stop, CASE WHEN st.pivot_price >= nb.close THEN 'price_below_stop' WHEN (nb.close - st.pivot_price) / nb.close > 0.06 THEN 'stop_too_far' WHEN (nb.close - st.pivot_price) / nb.close < 0.01 THEN 'stop_too_tight' ELSE 'taken' END AS reason FROM st JOIN nb USING (symbol, i) WHERE st.kind = 'low'")
def _(spark, sf):
    return E.candidates(E.prepared(L.bars(spark, sf)), "bos").select("symbol", "i", "entry", "stop", "reason")


@query("e_h3", f"{PIVOTS}, r AS (SELECT st.symbol, st.i, nb.low, nb.close, st.kind, st.pivot_price, CASE WHEN st.kind = 'low' THEN coalesce(st.pivot_price > lag(st.pivot_price) OVER (PARTITION BY st.symbol, st.kind ORDER BY st.i), false) END AS up FROM st JOIN nb USING (symbol, i)), x AS (SELECT *, coalesce({LAST.format('up')}, false) AS rises, {LAST.format('(CASE WHEN kind = ' + chr(39) + 'low' + chr(39) + ' THEN pivot_price END)')} AS sw FROM r), c AS (SELECT symbol, i, close, least(low, sw) AS stop FROM x WHERE rises AND close > sw) SELECT symbol, i, close AS entry, stop, {REASON} AS reason FROM c")
def _(spark, sf):
    return E.candidates(E.prepared(L.bars(spark, sf)), "h3").select("symbol", "i", "entry", "stop", "reason")


@query("e_rsi", f"{RSI}, x AS (SELECT b.symbol, b.time, ri.i, b.close, ri.rsi, lag(ri.rsi) OVER (PARTITION BY b.symbol ORDER BY b.time) AS pr, min(low) OVER (PARTITION BY b.symbol ORDER BY b.time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) * 0.999 AS stop FROM b JOIN ri USING (symbol, time)) SELECT symbol, i, close AS entry, round(stop, 6) AS stop, {REASON} AS reason FROM x WHERE pr < 30 AND rsi >= 30")
def _(spark, sf):
    return rounded(E.candidates(E.prepared(L.bars(spark, sf)), "rsi").select("symbol", "i", "entry", "stop", "reason"), "stop")


TOUCH = f"""{PIVOTS}, lv AS (SELECT symbol, i AS at, kind, pivot_price AS p, kind = 'low' AND coalesce(pivot_price > lag(pivot_price) OVER (PARTITION BY symbol, kind ORDER BY i), false) AS up FROM st WHERE kind IS NOT NULL),
su AS (SELECT nb.symbol, nb.i, nb.low, nb.close, arg_min(lv.p, (abs(nb.low - lv.p), lv.at)) AS support FROM nb JOIN lv ON lv.symbol = nb.symbol AND lv.kind = 'low' AND lv.at < nb.i AND nb.low BETWEEN 0.98 * lv.p AND 1.004 * lv.p GROUP BY ALL),
sx AS (SELECT su.symbol, su.i, close, least(low, support) - 0.001 * close AS stop, (SELECT min(h.p) FROM lv h WHERE h.symbol = su.symbol AND h.kind = 'high' AND h.at < su.i AND h.p > su.close) AS above,
  (SELECT arg_max(l.up, l.at) FROM lv l WHERE l.symbol = su.symbol AND l.kind = 'low' AND l.at < su.i) AS rises FROM su WHERE close > support)"""


def _support_query(mode: str, when: str):
    @query(f"e_{mode}", f"{TOUCH} SELECT symbol, i, close AS entry, round(stop, 6) AS stop, round(coalesce(above, close + 4 * (close - stop)), 6) AS target, {REASON} AS reason FROM sx WHERE {when}")
    def _(spark, sf):
        found = E.candidates(E.with_levels(E.prepared(L.bars(spark, sf))), mode)
        return rounded(found.select("symbol", "i", "entry", "stop", "target", "reason"), "stop", "target")


_support_query("support", "true")
_support_query("rev", "rises")


@query("e_vol_contraction", f"""{PREP}, q AS (SELECT *, coalesce(pa < 0.9 * median(atr) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), false) AS quiet FROM k),
n AS (SELECT *, least(50, i - 1 - coalesce(max(CASE WHEN NOT quiet THEN i END) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) AS run FROM q),
c AS (SELECT n.symbol, n.i, n.close, min(o.low) - 0.001 * n.close AS stop, max(o.high) AS top FROM n JOIN n o ON o.symbol = n.symbol AND o.i >= n.i - n.run AND o.i < n.i WHERE n.run >= 5 GROUP BY n.symbol, n.i, n.close)
SELECT symbol, i, close AS entry, round(stop, 6) AS stop, {REASON} AS reason FROM c WHERE close > top""")
def _(spark, sf):
    """Breaks out of a quiet run. The walk of the trades lens has steady steps, so 0.9 of the median counts as quiet here; the operator's default is 0.5."""
    bars = E.with_contraction(E.prepared(L.bars(spark, sf)), ratio=0.9)
    return rounded(E.candidates(bars, "vol_contraction").select("symbol", "i", "entry", "stop", "reason"), "stop")


def _pivots_at(minutes: int) -> str:
    """The CTEs b, nb and st for bars of another interval, under other names."""
    text = PIVOTS.replace(f"WITH RECURSIVE {L.MINUTES}", "").replace(L.coarse(), L.coarse("b", minutes))
    return re.sub(r"\b(b|nb|st)\b(?! ?\.\.)", lambda m: f"{m[1]}{minutes}", text)


def _known(minutes: int, value: str, name: str) -> str:
    """CTE of a value of the higher interval by the time at which its bar is closed."""
    return f", {name} AS (SELECT nb{minutes}.symbol, nb{minutes}.time + {minutes * 60} AS time, {value} AS v FROM st{minutes} JOIN nb{minutes} USING (symbol, i))"


HIGHER = PIVOTS + _pivots_at(240) + _pivots_at(720)
for _m in (240, 720):
    HIGHER += _known(_m, f"last_value(CASE st{_m}.kind WHEN 'low' THEN 'bull' WHEN 'high' THEN 'bear' END IGNORE NULLS) OVER (PARTITION BY st{_m}.symbol ORDER BY st{_m}.i ROWS UNBOUNDED PRECEDING)", f"bias{_m}")
BREAKS = "SELECT st.symbol, st.i, nb.time, nb.close, st.pivot_price AS stop, x.v AS four, y.v AS twelve FROM st JOIN nb USING (symbol, i) ASOF LEFT JOIN bias240 x ON x.symbol = st.symbol AND nb.time + 3600 >= x.time ASOF LEFT JOIN bias720 y ON y.symbol = st.symbol AND nb.time + 3600 >= y.time WHERE st.kind = 'low'"


def biased(spark, sf, bars):
    """bars with the biases of four and twelve hours as of their close."""
    at = bars.withColumn("__open", F.col("time")).withColumn("time", F.col("time") + 3600)
    for minutes in (240, 720):
        higher = P.with_bias(P.with_pivots(L.bars(spark, sf, minutes))).select("symbol", (F.col("time") + minutes * 60).alias("time"), F.col("bias").alias(f"bias{minutes}"))
        at = J.as_of(at, higher, f"bias{minutes}")
    return at.withColumn("time", F.col("__open")).drop("__open")


@query("e15_alignment", f"{HIGHER}, e AS ({BREAKS}) SELECT symbol, i, four, twelve, true AS \"none\", coalesce(four = 'bull', false) AS \"first\", coalesce(four <> 'bear', true) AND coalesce(twelve <> 'bear', true) AS notbear, coalesce(four = 'bull', false) AND coalesce(twelve = 'bull', false) AS \"all\" FROM e")
def _(spark, sf):
    """Every confirmed low under the four modes of alignment with the biases of four and twelve hours."""
    lows = biased(spark, sf, P.with_pivots(L.bars(spark, sf))).filter("pivot = 'low'")
    both = [F.col("bias240"), F.col("bias720")]
    return lows.select("symbol", "i", both[0].alias("four"), both[1].alias("twelve"), *(E.aligned(both, m).alias(m) for m in ("none", "first", "notbear", "all")))


@query("e1_bos_gates", f"""{HIGHER}, e AS ({BREAKS}), lw AS (SELECT symbol, i, coalesce(pivot_price > lag(pivot_price) OVER (PARTITION BY symbol ORDER BY i), false) AS up FROM st WHERE kind = 'low'),
g AS (SELECT e.*, lw.up, (SELECT min(h.pivot_price) FROM st h WHERE h.symbol = e.symbol AND h.kind = 'high' AND h.i < e.i AND h.pivot_price > e.close) AS above FROM e JOIN lw USING (symbol, i))
SELECT symbol, i, close AS entry, stop, CASE WHEN stop >= close THEN 'price_below_stop' WHEN NOT coalesce(four <> 'bear', true) OR NOT coalesce(twelve <> 'bear', true) THEN 'not_aligned' WHEN (close - stop) / close > 0.06 THEN 'stop_too_far' WHEN (close - stop) / close < 0.01 THEN 'stop_too_tight' WHEN NOT up THEN 'not_higher_low' WHEN above - close < 2 * (close - stop) THEN 'no_room' ELSE 'taken' END AS reason FROM g""")
def _(spark, sf):
    bars = biased(spark, sf, E.with_levels(E.prepared(L.bars(spark, sf))))
    return E.break_reasons(bars, E.aligned([F.col("bias240"), F.col("bias720")], "notbear"))


@query("e14_gated", f"""{PREP}{L.coarse('b4', 240)}, h AS (SELECT symbol, time + 14400 AS time, close > avg(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AND count(*) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 AS up FROM b4),
c AS (SELECT symbol, i, time, close, close - 2 * pa AS stop, volume FROM k WHERE close > don AND pa IS NOT NULL)
SELECT c.symbol, i, close AS entry, stop, CASE WHEN stop >= close THEN 'price_below_stop' WHEN (close - stop) / close > 0.06 THEN 'stop_too_far' WHEN (close - stop) / close < 0.01 THEN 'stop_too_tight' WHEN NOT coalesce(h.up, false) THEN 'trend_gate' WHEN NOT volume > 100 THEN 'external_gate' ELSE 'taken' END AS reason FROM c ASOF LEFT JOIN h ON h.symbol = c.symbol AND c.time + 3600 >= h.time""")
def _(spark, sf):
    """Breakouts behind the gates of the trend (four-hour close above its mean of 20) and of an external column (the volume)."""
    four = L.bars(spark, sf, 240)
    up = four.select("symbol", (F.col("time") + 14400).alias("time"), F.coalesce(F.col("close") > I.sma("close", 20), F.lit(False)).alias("up"))
    bars = E.prepared(L.bars(spark, sf)).withColumn("__open", F.col("time")).withColumn("time", F.col("time") + 3600)
    met = J.as_of(bars, up, "up").withColumn("time", F.col("__open")).drop("__open")
    return E.candidates(met, "breakout", gate=F.col("volume") > 100, trend=F.col("up")).select("symbol", "i", "entry", "stop", "reason")


def _chain(when: str, stop: str, target_r: float, hold: int, cost: float, most: float = 0.06, least: float = 0.01) -> str:
    """SQL of the trades of a rule with stop, target and time limit: every entry's own exit, then the chain of entries that are free."""
    return f"""{PREP.replace('WITH', 'WITH RECURSIVE', 1)}, c AS MATERIALIZED (SELECT symbol, i, close AS entry, ({stop}) AS stop FROM k WHERE {when} AND ({stop}) < close AND (close - ({stop})) / close BETWEEN {least} AND {most}),
    x AS (SELECT c.symbol, c.i, c.entry, c.stop, min(k.i) FILTER (k.low <= c.stop) AS sa, min(k.i) FILTER (k.high >= c.entry + {target_r} * (c.entry - c.stop)) AS ta, min(k.i) FILTER (k.i - c.i = {hold}) AS ha
      FROM c LEFT JOIN k ON k.symbol = c.symbol AND k.i > c.i AND k.i <= c.i + {hold} GROUP BY ALL),
    y AS (SELECT *, least(sa, ta, ha) AS out FROM x), z AS MATERIALIZED (SELECT y.*, CASE WHEN out = sa THEN y.stop WHEN out = ta THEN entry + {target_r} * (entry - y.stop) ELSE k.close END AS px, CASE WHEN out = sa THEN 'stop' WHEN out = ta THEN 'target' ELSE 'timeout' END AS label FROM y LEFT JOIN k ON k.symbol = y.symbol AND k.i = y.out),
    ch AS (SELECT symbol, min(i) AS i FROM z GROUP BY 1 UNION ALL SELECT ch.symbol, (SELECT min(n.i) FROM z n WHERE n.symbol = ch.symbol AND n.i > z.out) FROM ch JOIN z ON z.symbol = ch.symbol AND z.i = ch.i WHERE z.out IS NOT NULL AND EXISTS (SELECT 1 FROM z n WHERE n.symbol = ch.symbol AND n.i > z.out)),
    tr2 AS (SELECT z.symbol, z.i AS entry_i, z.out AS exit_i, z.entry, z.label, (px - entry) / (entry - stop) - {cost} * (entry + px) / (entry - stop) AS r FROM ch JOIN z USING (symbol, i) WHERE z.out IS NOT NULL)"""


def _taken(spark, sf, mode: str):
    bars = settled(E.prepared(L.bars(spark, sf)), "prepared")  # read by the entries and by their exits
    return bars, E.candidates(bars, mode).filter("reason = 'taken'")


@query("x_breakout_trades", f"{_chain(*RULES['breakout'], 4.0, 300, 0.0045)} SELECT symbol, entry_i, exit_i, entry, label, round(r, 5) AS r FROM tr2")
def _(spark, sf):
    bars, found = _taken(spark, sf, "breakout")
    return X.simulate(bars, found, [X.Exit("live")]).select("symbol", "entry_i", "exit_i", "entry", "label", F.round("r", 5).alias("r"))


@query("x_sweep_trades", f"{_chain(*RULES['sweep_reclaim'], 2.0, 48, 0.001)} SELECT symbol, entry_i, exit_i, entry, label, round(r, 5) AS r FROM tr2")
def _(spark, sf):
    bars, found = _taken(spark, sf, "sweep_reclaim")
    return X.simulate(bars, found, [X.Exit("short", target_r=2.0, max_hold=48, cost=0.001)]).select("symbol", "entry_i", "exit_i", "entry", "label", F.round("r", 5).alias("r"))


@query("x_summary", f"{_chain(*RULES['breakout'], 4.0, 300, 0.0045)}, p AS (SELECT symbol, count(*) AS n, sum(r) AS t, count(*) FILTER (r > 0) AS w, count(*) FILTER (label = 'timeout') AS o FROM tr2 GROUP BY 1) SELECT 'live' AS config, sum(n)::BIGINT AS trades, round(sum(t) / sum(n), 5) AS avg_r, round(sum(w) / sum(n), 6) AS win_rate, count(*) FILTER (t > 0) AS positive_assets, round(sum(o) / sum(n), 6) AS timeout_rate FROM p HAVING count(*) > 0")
def _(spark, sf):
    bars, found = _taken(spark, sf, "breakout")
    return X.summarize(X.simulate(bars, found, [X.Exit("live")]), "config").select("config", "trades", F.round("avg_r", 5).alias("avg_r"), r6("win_rate").alias("win_rate"), "positive_assets", r6("timeout_rate").alias("timeout_rate"))


#: Exit models of the sweep.
EXITS = [
    X.Exit("live"), X.Exit("target2", target_r=2.0), X.Exit("trail1", target_r=1e9, trail_r=1.0), X.Exit("trail2", target_r=1e9, trail_r=2.0, trail_start_r=2.0), X.Exit("scale", partial_at_r=1.0), X.Exit("scale_trail", target_r=1e9, partial_at_r=1.0, trail_r=1.0),
    X.Exit("lock", lock_at_r=1.0), X.Exit("lock_fee", lock_at_r=1.0, fee_buffer=0.01), X.Exit("pullback5", trailing_target=0.05), X.Exit("swing", swing_high=True), X.Exit("hold48", max_hold=48), X.Exit("delay2", delay=2), X.Exit("free", cost=0.0),
]


@query("x_exit_sweep")
def _(spark, sf):
    bars, found = _taken(spark, sf, "breakout")
    return X.summarize(X.simulate(bars, found, EXITS), "config")


@query("c8_delay_curve")
def _(spark, sf):
    """Breakouts entered up to five bars late, at the open."""
    bars, found = _taken(spark, sf, "breakout")
    return X.summarize(X.simulate(bars, found, [X.Exit(f"delay{d}", delay=d) for d in range(6)]), "config")


@query("c8_holding_map", f"{_chain(*RULES['sweep_reclaim'], 2.0, 48, 0.001)} SELECT (exit_i - entry_i) // 6 AS held, count(*) AS n, round(avg(r), 5) AS avg_r, round(avg(0.001 * (entry + px) / risk), 5) AS avg_cost FROM (SELECT tr2.*, z.px, z.entry - z.stop AS risk FROM tr2 JOIN z ON z.symbol = tr2.symbol AND z.i = tr2.entry_i) GROUP BY 1")
def _(spark, sf):
    """What trades give and what their costs take, by six bars of holding."""
    bars, found = _taken(spark, sf, "sweep_reclaim")
    runs = X.simulate(bars, found, [X.Exit("short", target_r=2.0, max_hold=48, cost=0.001)])
    paid = 0.001 * (F.col("entry") + F.col("exit_price")) / F.col("risk")
    return runs.groupBy(F.floor((F.col("exit_i") - F.col("entry_i")) / 6).alias("held")).agg(F.count("*").alias("n"), F.round(F.avg("r"), 5).alias("avg_r"), F.round(F.avg(paid), 5).alias("avg_cost"))


@query("x_tournament")
def _(spark, sf):
    """All entry rules under the live exit and without costs."""
    bars = settled(E.with_contraction(E.with_levels(settled(E.prepared(L.bars(spark, sf)), "prepared"))), "levels")
    parts = E.every_candidate(bars, min_stop=None)
    # a mode of a symbol is a series of its own
    runs = X.simulate(bars, parts, [X.Exit("net"), X.Exit("gross", cost=0.0)], ("symbol", "mode"))
    return X.summarize(runs, "mode", "config")


@query("x3_profile", f"""{PREP}, e AS MATERIALIZED (SELECT symbol, i, close AS entry, close - 2 * pa AS stop, (close - (close - 2 * pa)) / close AS stop_share, close / s20 - 1 AS ma_share, volume / nullif(v20, 0) AS volume_ratio, pa / close AS atr_share FROM (SELECT *, max(i) OVER (PARTITION BY symbol) AS last FROM k) WHERE close > don AND pa > 0 AND 2 * pa / close <= 0.06 AND i + 100 <= last),
f AS (SELECT e.symbol, e.i, min(k.i) FILTER (k.low <= e.stop) AS sa, min(k.i) FILTER (k.high >= e.entry + 4 * (e.entry - e.stop)) AS ta FROM e JOIN k ON k.symbol = e.symbol AND k.i > e.i AND k.i <= e.i + 100 GROUP BY 1, 2)
SELECT symbol, i, CASE WHEN sa IS NOT NULL AND (ta IS NULL OR sa <= ta) THEN 'loss' WHEN ta IS NOT NULL THEN 'win' ELSE 'open' END AS outcome, round(stop_share, 6) AS stop_share, round(ma_share, 6) AS ma_share, round(volume_ratio, 6) AS volume_ratio, round(atr_share, 6) AS atr_share FROM e JOIN f USING (symbol, i)""")
def _(spark, sf):
    """Breakouts with their outcome within 100 bars and what was known at the entry."""
    bars = E.with_levels(E.prepared(L.bars(spark, sf)))
    rows = E.profile(bars, E.candidates(bars, "breakout", min_stop=None).filter("reason = 'taken'"), 100)
    return rounded(rows.select("symbol", "i", "outcome", "stop_share", "ma_share", "volume_ratio", "atr_share"), "stop_share", "ma_share", "volume_ratio", "atr_share")


@query("x4_excursions", f"{_chain(*RULES['breakout'], 4.0, 300, 0.0045)} SELECT r > 0 AS win, count(*) AS n, round(median(exit_i - entry_i), 6) AS median_held, round(median(mae), 6) AS median_mae, round(median(mfe), 6) AS median_mfe FROM (SELECT tr2.symbol, entry_i, any_value(exit_i) AS exit_i, any_value(tr2.r) AS r, greatest(0, any_value((tr2.entry - w.lo) / risk)) AS mae, greatest(0, any_value((w.hi - tr2.entry) / risk)) AS mfe FROM tr2 JOIN (SELECT t.symbol, t.entry_i AS at, t.entry - z.stop AS risk, min(k.low) AS lo, max(k.high) AS hi FROM tr2 t JOIN z ON z.symbol = t.symbol AND z.i = t.entry_i JOIN k ON k.symbol = t.symbol AND k.i > t.entry_i AND k.i <= t.exit_i GROUP BY ALL) w ON w.symbol = tr2.symbol AND w.at = tr2.entry_i GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    bars, found = _taken(spark, sf, "breakout")
    runs = X.simulate(bars, found, [X.Exit("live")])
    return runs.groupBy((F.col("r") > 0).alias("win")).agg(F.count("*").alias("n"), r6(F.median(F.col("exit_i") - F.col("entry_i"))).alias("median_held"), r6(F.median("mae")).alias("median_mae"), r6(F.median("mfe")).alias("median_mfe"))


STOPS, TARGETS = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0], [1.0, 1.5, 2.0, 3.0, 4.0, 6.0]


@query("x2_stop_target_grid", f"""{PREP}, e AS MATERIALIZED (SELECT symbol, i, close, pa FROM (SELECT *, max(i) OVER (PARTITION BY symbol) AS last FROM k) WHERE close > don AND pa > 0 AND i + 200 <= last),
sk AS (SELECT e.symbol, e.i, k_stop, min(k.i) FILTER (k.low <= e.close - k_stop * e.pa) AS sa FROM e, (SELECT unnest({STOPS}::DOUBLE[]) AS k_stop), k WHERE k.symbol = e.symbol AND k.i > e.i AND k.i <= e.i + 200 GROUP BY ALL),
tk AS (SELECT e.symbol, e.i, k_target, min(k.i) FILTER (k.high >= e.close + k_target * e.pa) AS ta FROM e, (SELECT unnest({TARGETS}::DOUBLE[]) AS k_target), k WHERE k.symbol = e.symbol AND k.i > e.i AND k.i <= e.i + 200 GROUP BY ALL)
SELECT k_stop, k_target, count(*) AS n, count(*) FILTER (ta IS NOT NULL AND (sa IS NULL OR ta < sa)) AS wins, count(*) FILTER (sa IS NOT NULL AND (ta IS NULL OR sa <= ta)) AS losses, count(*) FILTER (sa IS NULL AND ta IS NULL) AS open FROM sk JOIN tk USING (symbol, i) GROUP BY 1, 2""")
def _(spark, sf):
    """First passages of 7 stops and 6 targets within 200 bars of each breakout; a bar that reaches both is a loss."""
    bars = E.prepared(L.bars(spark, sf))
    entries = bars.filter("close > top20 and atr_before > 0").select("symbol", "i", "close", F.col("atr_before").alias("unit"))
    return J.first_passages(entries, bars, 200, STOPS, TARGETS)
