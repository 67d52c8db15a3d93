"""Market-shaped views of the star-schema tables, in Spark and as DuckDB common table expressions.

The price of the trades lens is an integer walk, exact in doubles, so results do not depend on the
order of float sums. On larger tables it passes zero: it is a level of any sign.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, seq, sec, price, volume, side: the events as trades."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    step = (1 + (k + F.col("user_id")) % 10) * F.when(k % 2 == 0, 1).otherwise(-1)
    walk = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), F.floor(micros(F.col("ts")) / 1_000_000).cast("long").alias("sec"),
        (2000 + F.sum(step).over(walk)).cast("double").alias("price"), k.cast("double").alias("volume"), F.when(F.col("user_id") % 2 == 0, "b").otherwise("s").alias("side"),
    )


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.aggregate_trades(trades(spark, sf_dir))


def bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Bars of the trades at a coarser interval, complete ones only by construction of the table."""
    return B.resample(minute_bars(spark, sf_dir), minutes)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (nation), week, close, volume: the last order of each week by key."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    week = F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1994-12-26").cast("date")) / 7).cast("long")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    keyed = rows.select(F.col("n_name").alias("symbol"), week.alias("week"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_totalprice").alias("price"))
    return keyed.groupBy("symbol", "week").agg(F.max_by("price", "at").alias("close"), F.count("*").cast("double").alias("volume"))


TRADES = """
trades AS (
  SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000000 AS sec, k::DOUBLE AS volume,
    CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 's' END AS side,
    (2000 + sum((1 + (k + user_id) % 10) * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS price
  FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k FROM events))"""

MINUTES = TRADES + """,
m1 AS (
  SELECT symbol, sec // 60 * 60 AS time, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume,
    coalesce(sum(volume) FILTER (side = 'b'), 0) AS buy_vol, coalesce(sum(volume) FILTER (side <> 'b'), 0) AS sell_vol, count(*) AS trades, max(volume) AS max_trade
  FROM trades GROUP BY 1, 2)"""


def coarse(name: str = "b", minutes: int = 60) -> str:
    """CTE of bars of so many minutes over m1."""
    return f""",
{name} AS (
  SELECT symbol, time // {minutes * 60} * {minutes * 60} AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume,
    sum(buy_vol) AS buy_vol, sum(sell_vol) AS sell_vol, sum(trades)::BIGINT AS trades, max(max_trade) AS max_trade
  FROM m1 GROUP BY 1, 2)"""


BARS = MINUTES + coarse()

WEEKLY = """
wk AS (
  SELECT n_name AS symbol, date_diff('day', DATE '1994-12-26', o_orderdate::DATE) // 7 AS week, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*)::DOUBLE AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
