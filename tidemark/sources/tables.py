"""Sources and sinks: bars as CSV, transposed API responses, funding histories, experiments, journals.

Everything goes through Spark's readers and writers; folders are the caller's and must be shared on a cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators.bars import one_of_each

BAR_SCHEMA = "symbol string, time long, open double, high double, low double, close double, volume double, buy_vol double, sell_vol double, trades long, max_trade double"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below the session's checkpoint folder, which a cluster must name; a local session has a temporary one without it."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tidemark.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.tidemark.dir", top)  # the other setting is fixed once the session runs
    return f"{top.rstrip('/')}/tidemark-{name}"


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read again: what is used several times is made once, and a lost executor repeats nothing before it."""
    folder = shared_folder(df.sparkSession, f"{purpose}-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_bars(bars: DataFrame, folder: str) -> None:
    """Whole rewrite, one bar for each symbol and minute, sorted in its files."""
    one_of_each(bars, ["symbol", "time"]).repartition("symbol").sortWithinPartitions("symbol", "time").write.mode("overwrite").option("header", True).csv(folder)


def read_bars(spark: SparkSession, folder: str, signed: bool = False) -> DataFrame:
    """Strict: a malformed row or one that breaks a bar's rules ends the read. signed: levels of any sign, not prices."""
    rows = spark.read.schema(BAR_SCHEMA).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(folder)
    broken = F.when(B.invalid(signed=signed), F.raise_error(F.concat(F.lit("no bar: "), F.to_json(F.struct("symbol", "time"))))).otherwise(F.col("time"))
    return rows.withColumn("time", broken.cast("long"))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of the rows of a key the one that is last by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent merge: incoming rows win, rows without a complete key go."""
    known = stored.filter(" and ".join(f"{k} is not null" for k in keys))
    fresh = incoming.filter(" and ".join(f"{k} is not null" for k in keys))
    return known.join(fresh, keys, "left_anti").unionByName(one_of_each(fresh, keys))


def transposed(responses: DataFrame, times: str, values: str, *keys: str) -> DataFrame:
    """Points of parallel arrays, as many as the shorter has; those without a time go."""
    n = F.least(F.size(times), F.size(values))
    cut = responses.select(*keys, F.slice(F.col(times), 1, n).alias("t"), F.slice(F.col(values), 1, n).alias("v"))
    pairs = F.arrays_zip("t", "v")
    return cut.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p")["t"].alias("timestamp"), F.col("p")["v"].alias("value")).filter("timestamp is not null")


def points(responses: DataFrame, body: str, *keys: str) -> DataFrame:
    """keys, shape, timestamp, value (JSON) of API responses as text: ``result.timestamp`` and ``result.data`` in one of three shapes.

    array: one value for each time. parallel: named arrays of values; a single name around them is taken away. nested: named
    sides of named arrays. Points are as many as the shortest array has; those whose time is no number go. A response of
    another form ends the query.
    """
    is_a = lambda kind, x: F.coalesce(F.schema_of_variant(x).startswith(kind), F.lit(False))
    entries = lambda x: F.map_entries(x.cast("map<string, variant>"))
    part = lambda name: F.try_variant_get(F.col("_v"), f"$.result.{name}", "variant")
    read = responses.select(*keys, F.try_parse_json(body).alias("_v")).select(*keys, part("timestamp").alias("_t"), part("data").alias("_d"))
    sound = is_a("ARRAY", F.col("_t")) & (is_a("ARRAY", F.col("_d")) | is_a("OBJECT", F.col("_d")))
    read = read.withColumn("_sound", sound)
    read = read.withColumn("_e", F.when(is_a("OBJECT", F.col("_d")), entries(F.col("_d"))))
    lone = (F.size("_e") == 1) & is_a("OBJECT", F.try_element_at("_e", F.lit(1))["value"])
    read = read.withColumn("_e", F.when(lone, entries(F.try_element_at("_e", F.lit(1))["value"])).otherwise(F.col("_e")))
    listed = lambda e: F.transform(F.filter(e, lambda x: is_a("ARRAY", x["value"])), lambda x: F.struct(x["key"].alias("key"), x["value"].cast("array<variant>").alias("value")))
    read = read.withColumns({"_t": F.when(F.col("_sound"), F.col("_t").cast("array<variant>")).otherwise(F.array(F.parse_json(F.lit("0")))), "_a": F.when(F.col("_sound") & F.col("_e").isNull(), F.col("_d").cast("array<variant>")), "_p": listed(F.col("_e"))})
    sides = F.transform(F.filter("_e", lambda x: is_a("OBJECT", x["value"])), lambda x: F.struct(x["key"].alias("key"), listed(entries(x["value"])).alias("value")))
    read = read.withColumn("_n", F.when(F.size("_p") == 0, F.filter(sides, lambda x: F.size(x["value"]) > 0)))
    shortest = lambda e: F.array_min(F.transform(e, lambda x: F.size(x["value"])))
    shape = F.when(F.col("_a").isNotNull(), "array").when(F.size("_p") > 0, "parallel").otherwise("nested")
    size = F.when(F.col("_a").isNotNull(), F.size("_a")).when(F.size("_p") > 0, shortest(F.col("_p"))).otherwise(F.coalesce(F.array_min(F.transform("_n", lambda x: shortest(x["value"]))), F.lit(0)))
    at = lambda e, i: F.map_from_entries(F.transform(e, lambda x: F.struct(x["key"].alias("key"), F.get(x["value"], i).alias("value"))))
    value = lambda i: F.when(F.col("_a").isNotNull(), F.to_json(F.get("_a", i))).when(F.size("_p") > 0, F.to_json(at(F.col("_p"), i))).otherwise(F.to_json(F.map_from_entries(F.transform("_n", lambda x: F.struct(x["key"].alias("key"), at(x["value"], i).alias("value"))))))
    indices = F.slice(F.sequence(F.lit(0), F.greatest(F.size("_t"), F.lit(1))), F.lit(1), F.least(F.size("_t"), size))
    indices = F.when(F.col("_sound"), indices).otherwise(F.raise_error(F.lit("a response without result.timestamp and result.data")))
    found = read.withColumn("shape", shape).withColumn("_i", F.explode(indices))
    found = found.select(*keys, "shape", F.try_variant_get(F.get("_t", F.col("_i")), "$", "double").alias("timestamp"), value(F.col("_i")).alias("value"))
    return found.filter("timestamp is not null and not isnan(timestamp)")


def replace_days(rows: DataFrame, folder: str) -> None:
    """Writes bars into a table of folders by symbol and day: the days of rows are replaced whole, other folders aren't touched."""
    days = one_of_each(rows, ["symbol", "time"]).withColumn("day", F.floor(F.col("time") / 86400))
    dealt = days.repartition("symbol", "day").sortWithinPartitions("symbol", "day", "time")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "day").parquet(folder)


def dated_values(spark: SparkSession, path: str, missing: str = ".") -> DataFrame:
    """A CSV of date and value in which a mark stands for a missing value."""
    return spark.read.schema("date date, value double").option("header", True).option("nullValue", missing).csv(path).filter("value is not null")


def provenance(parameters: dict) -> str:
    """SHA-256 of the parameters as JSON with sorted keys."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def series_digest(bars: DataFrame, *keys: str) -> DataFrame:
    """SHA-256 of each series' count, first and last bar."""
    first, last = F.min_by("close", "time"), F.max_by("close", "time")
    text = F.concat_ws(":", *keys, F.count("*"), F.min("time"), first.cast("long"), F.max("time"), last.cast("long"))
    return bars.groupBy(*keys).agg(F.sha2(text, 256).alias("digest"))


def append_events(events: DataFrame, folder: str) -> None:
    events.write.mode("append").json(folder)


def last_events(spark: SparkSession, folder: str, schema: str, wanted: str, limit: int) -> DataFrame:
    """The newest ``limit`` events of a schema."""
    return spark.read.schema(schema).json(folder).filter(F.col("schema") == wanted).orderBy(F.col("at").desc(), F.col("id").desc()).limit(limit)


def clean_history(chunks: DataFrame, signed: bool = False) -> DataFrame:
    """Fetched bars (symbol, time, open, high, low, close, volume, chunk): the last chunk's row of each time, invalid ones (of prices, or of levels of any sign) dropped, flow columns of 0."""
    newest = latest(chunks, ["symbol", "time"], F.struct("chunk", "close")).drop("chunk")
    filled = newest.withColumns({"buy_vol": F.lit(0.0), "sell_vol": F.lit(0.0), "trades": F.lit(0).cast("long"), "max_trade": F.lit(0.0)})
    return filled.filter(~B.invalid(signed=signed))


def content_key(rows: DataFrame) -> str:
    """A digest of the rows whatever their order: their number, and the sum and the exclusive or of their hashes."""
    digest = F.xxhash64(*sorted(rows.columns))
    found = rows.agg(F.count("*"), F.coalesce(F.sum((digest % 1_000_000_007).cast("decimal(20, 0)")), F.lit(0)), F.coalesce(F.bit_xor(digest), F.lit(0))).first()
    return "-".join(str(x) for x in found).replace("--", "-m")


def materialised(rows: DataFrame, make, parameters: dict, folder: str) -> DataFrame:
    """make(rows), written once for each content of rows and parameters, and read again; a broken or unfinished table is made anew."""
    spark = rows.sparkSession
    at = f"{folder}/{content_key(rows)}-{provenance(parameters)[:16]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        try:
            held = spark.read.parquet(at)
            held.agg(*(F.max(F.col(c).isNull()) for c in held.columns)).collect()  # every column of every file can be read
            return held
        except Exception as broken:  # noqa: BLE001
            print(f"{at} is made anew: {str(broken)[:200]}")
    make(rows).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
