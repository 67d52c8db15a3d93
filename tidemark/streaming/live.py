"""The live path on Structured Streaming: bars that close behind a watermark, late and repeated rows, halts by state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.tables import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Rows of event files as they arrive: (event_id, ts, symbol, value)."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), "value")


def closed_bars(events: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Bars of windows that the watermark has passed; open windows are not given."""
    window = F.window("ts", f"{minutes} minutes")
    order = F.struct("ts", "event_id")
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "symbol").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("trades"),
    ).select("symbol", F.unix_timestamp(F.col("w.start")).alias("time"), "open", "high", "low", "close", "trades")


def once_each(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repetitions inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_halts(events: DataFrame, limit: float) -> DataFrame:
    """(symbol, day, halted_at): when the sum of a day's values less its peak first fell below -limit; days are those of New York.

    State per symbol and day: sum, peak and whether it has halted; it goes a day of event time after the last row.
    Rows of a micro-batch are taken in order of event time.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, peak, halted = state.get if state.exists else (0.0, 0.0, False)
        rows = pd.concat(parts).sort_values(["ts", "event_id"])
        at = None
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            total += value
            peak = max(peak, total)
            if not halted and total - peak < -limit:
                halted, at = True, ts
        state.update((total, peak, halted))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + 86_400_000 + 600_000)
        if at is not None:
            yield pd.DataFrame({"symbol": [key[0]], "day": [key[1]], "halted_at": [at]})

    dated = events.withWatermark("ts", "10 minutes").withColumn("day", F.date_format(F.from_utc_timestamp("ts", "America/New_York"), "yyyy-MM-dd"))
    return dated.groupBy("symbol", "day").applyInPandasWithState(step, "symbol string, day string, halted_at timestamp", "total double, peak double, halted boolean", "append", GroupStateTimeout.EventTimeTimeout)


def cool_down(touches: DataFrame, seconds: int) -> DataFrame:
    """(symbol, level, alerted_at) of touches (symbol, level, ts, event_id): a level is silent for so long after an alert.

    State per symbol and level: the time of its last alert; it goes when the level may speak again. Rows of a micro-batch
    are taken in order of event time.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (last,) = state.get if state.exists else (None,)
        alerts = []
        for ts in pd.concat(parts).sort_values(["ts", "event_id"])["ts"]:
            now = int(ts.timestamp() * 1_000_000)
            if last is None or now >= last + seconds * 1_000_000:
                last = now
                alerts.append(ts)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"symbol": [key[0]] * len(alerts), "level": [key[1]] * len(alerts), "alerted_at": alerts})

    late = touches.withWatermark("ts", "10 minutes")
    return late.groupBy("symbol", "level").applyInPandasWithState(step, "symbol string, level long, alerted_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """All that is there now, through a checkpointed query into a table of files, read again."""
    spark = stream.sparkSession
    folder = shared_folder(spark, f"{name}-{uuid.uuid4().hex}")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_batches(stream: DataFrame, apply, name: str) -> None:
    """All that is there now, batch by batch through ``apply``, with a checkpoint of its own."""
    folder = shared_folder(stream.sparkSession, f"{name}-{uuid.uuid4().hex}")
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
