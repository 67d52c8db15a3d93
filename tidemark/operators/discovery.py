"""Rule discovery: which predicates on what was known at an entry select better outcomes than taking everything.

The null hypothesis keeps outcomes of a day together: whole days are laid end to end in a random order, and the record at a
place in time gets the outcome that comes to lie there. Records and outcomes are numbered once. A replica then is one offset for each
day, so what is drawn is a table of replicas and days. Outcomes travel as short arrays, once to each stretch of places that they come to lie in and
with the list of their offsets there; the predicates of a stretch are one array of bits. A stretch and an array are bounded, so a day of very many
records is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.inference import draw, replicas
from tidemark.operators.stats import with_q_values
from tidemark.sources.tables import settled

#: Outcomes of an array, and places of a stretch.
PIECE, STRETCH = 1024, 16_384


def predicates() -> dict[str, Column]:
    """The rules over the columns of a profile; a rule is false where its column is null, but for the room above."""
    c = F.col
    room = lambda r: c("room_r").isNull() | (c("room_r") > r)
    lead_bull, swept, gap, near_low, wide = c("lead_bias") == "bull", c("swept"), c("gap"), c("low_share") < 0.01, c("displacement") > 1.5
    found = {
        "room > 1R": room(1), "room > 2R": room(2), "room > 3R": room(3), "rsi < 30": c("rsi") < 30, "rsi < 40": c("rsi") < 40, "rsi > 60": c("rsi") > 60,
        "2 % below mean": c("ma_share") < -0.02, "above mean": c("ma_share") > 0, "low in range": c("range_place") < 0.3, "high in range": c("range_place") > 0.5, "higher low": c("higher_low"), "lower low": ~c("higher_low"),
        "stop < 2 %": c("stop_share") < 0.02, "stop > 2 %": c("stop_share") > 0.02, "middle bull": c("mid_bias") == "bull", "middle not bull": ~c("mid_bias").eqNullSafe("bull"), "high bull": c("high_bias") == "bull",
        "volume > 1.5": c("volume_ratio") > 1.5, "atr < 1 %": c("atr_share") < 0.01, "atr > 2 %": c("atr_share") > 0.02, "displacement > 1.5": wide, "swept a low": swept, "gap below": gap, "near yesterday's low": near_low, "far from yesterday's high": c("high_share") > 0.01,
        "leader bull": lead_bull, "leader not bull": c("lead_bias") != "bull", "leader up 3 %": c("lead_change") > 0.03, "leader down 3 %": c("lead_change") < -0.03,
        "swept and leader bull": swept & lead_bull, "swept and gap": swept & gap, "room > 2R and leader bull": (c("room_r") > 2) & lead_bull, "displaced and leader bull": wide & lead_bull, "near low and swept": near_low & swept, "gap and higher low": gap & c("higher_low"),
    }
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in found.items()}


def numbered_by_time(rows: DataFrame, order: list[str], slot: int = 3600) -> DataFrame:
    """rows with place, from 0 in the order of time and ``order``; only counts per slot of so many seconds meet in one task."""
    slotted = rows.withColumn("__slot", F.floor(F.col("time") / slot))
    before = F.sum("n").over(Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    begun = slotted.groupBy("__slot").agg(F.count("*").alias("n")).select("__slot", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__slot").orderBy("time", *order))
    return slotted.withColumn("__own", own).join(begun, "__slot").withColumn("place", F.col("__before") + F.col("__own") - 1).drop("__slot", "__before", "__own")


def _sums(rules: int, froms: list[int], stretch: int):
    """Partial sums of outcomes by replica, window and rule (the last rule takes all); replica -1 has the numbers of selected records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
        for bucket, group in groupby(rows, lambda row: row["bucket"]):
            bits = np.asarray(next(group)["bits"], np.int64)
            first = bucket * stretch
            mask = np.ones((len(bits), rules + 1))
            mask[:, :rules] = bits[:, None] >> np.arange(rules) & 1
            place = first + np.arange(len(bits))
            found = {-1: np.stack([mask[place >= x].sum(axis=0) for x in froms])}
            for row in group:
                values = np.asarray(row["values"], float)
                for replica, at in zip(row["replica"], row["at"], strict=True):
                    sums = found.setdefault(replica, np.zeros((len(froms), rules + 1)))
                    end = min(at + len(values), first + len(bits))
                    for w, x in enumerate(froms):
                        begin = max(at, first, x)
                        if begin < end:
                            sums[w] += values[begin - at : end - at] @ mask[begin - first : end - first]
            keys = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([found[x].ravel().tolist() for x in keys], pa.list_(pa.float64()))], ["replica", "sums"])

    return run


def discover(rows: DataFrame, rules: dict[str, Column], value: str, order: list[str], k: int = 1000, cuts: tuple[float, ...] = (0.5, 0.6, 0.7), least: int = 10, block: int = 86400, seed: str = "d") -> DataFrame:
    """Per rule: rule, n, mean, lift, p, q.

    rows: time, ``value`` (the outcome) and what the rules read; order: columns that tell rows of one time apart. A window is all rows later than
    the row at a share ``cuts`` of all. lift: how much the mean of the selected rows is above that of all rows, averaged over the windows
    with ``least`` selected rows or more, of which there must be two; n and mean are of the middle window. p: the share of replicas with
    a lift at least as large, one-sided, (hits + 1) / (k + 1), 1 without a lift; q: step-up value over the rules that have one.
    """
    if len(rules) > 62:
        raise ValueError("rules are bits of a long")
    spark = rows.sparkSession
    names = list(rules)
    bits = sum((F.when(rules[x], F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, x in enumerate(names)), F.lit(0).cast("long"))
    told = rows.filter(F.col(value).isNotNull()).select("time", *[c for c in order if c != "time"], F.col(value).cast("double").alias("y"), bits.alias("bits"))
    placed = settled(numbered_by_time(told, order).select("time", "place", "y", "bits"), "discovery").withColumn("day", F.floor(F.col("time") / block))
    n = placed.count()
    at = placed.filter(F.col("place").isin([int(n * x) for x in cuts])).select("place", "time").collect()  # a row for each window
    ends = {r.place: r.time for r in at}
    later = placed.agg(*(F.count_if(F.col("time") <= ends[int(n * x)]).cast("long").alias(f"w{i}") for i, x in enumerate(cuts))).first() if n else [0] * len(cuts)
    froms = [int(x or 0) for x in later]

    days = placed.groupBy("day").agg(F.count("*").alias("size"), F.min("place").alias("first"))
    shuffled = F.when(F.col("replica") == 0, F.lpad(F.col("day").cast("string"), 12, "0")).otherwise(draw(seed, "replica", "day"))
    both = replicas(days, k).unionByName(days.withColumn("replica", F.lit(0)))
    before = F.sum("size").over(Window.partitionBy("replica").orderBy(shuffled, "day").rowsBetween(Window.unboundedPreceding, -1))
    begun = both.select("replica", "day", "size", F.coalesce(before, F.lit(0)).alias("begin"))
    piece = F.floor((F.col("place") - F.col("first")) / PIECE)
    pieces = placed.join(days.select("day", "first"), "day").groupBy("day", piece.alias("piece")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "y"))), lambda x: x["y"]).alias("values"))
    moved = begun.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / PIECE)))).withColumn("at", F.col("begin") + F.col("piece") * PIECE)
    until = F.least(F.col("at") + PIECE, F.col("begin") + F.col("size")) - 1
    moved = moved.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at") / STRETCH), F.floor(until / STRETCH))))
    asked = moved.groupBy("day", "piece", "bucket").agg(F.collect_list("replica").alias("replica"), F.collect_list("at").alias("at"))  # a replica once at most
    outcomes = asked.join(pieces, ["day", "piece"]).select("bucket", F.lit(1).alias("kind"), "replica", "at", "values", F.lit(None).cast("array<long>").alias("bits"))
    masks = placed.groupBy(F.floor(F.col("place") / STRETCH).alias("bucket")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "bits"))), lambda x: x["bits"]).alias("bits")).withColumn("kind", F.lit(0))
    met = outcomes.unionByName(masks, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "kind")
    sums = met.mapInArrow(_sums(len(names), froms, STRETCH), "replica int, sums array<double>")
    cells = sums.select("replica", F.posexplode("sums").alias("cell", "s")).groupBy("replica", "cell").agg(F.sum("s").alias("s"))
    width = len(names) + 1
    cells = cells.select("replica", F.floor(F.col("cell") / width).alias("w"), (F.col("cell") % width).alias("rule"), "s")
    counts = cells.filter("replica = -1").select("w", "rule", F.col("s").alias("n"))
    means = cells.filter("replica >= 0").join(counts, ["w", "rule"]).withColumn("m", F.try_divide("s", "n"))
    whole = means.filter(F.col("rule") == width - 1).select("replica", "w", F.col("m").alias("all"))
    lifts = means.filter((F.col("rule") < width - 1) & (F.col("n") >= least)).join(whole, ["replica", "w"]).groupBy("replica", "rule").agg(F.avg(F.col("m") - F.col("all")).alias("lift"), F.count("*").alias("windows")).filter("windows >= 2")
    own = lifts.filter("replica = 0").select("rule", F.col("lift").alias("true"))
    # float sums come in any order; equal lifts count as at least as large
    hits = lifts.filter("replica > 0").join(own, "rule").groupBy("rule").agg(((F.count_if(F.col("lift") >= F.col("true") - 1e-12) + 1) / (k + 1)).alias("p"))
    tested = with_q_values(own.join(hits, "rule").withColumn("family", F.lit(0)), "p", ["family"])
    middle = means.filter((F.col("replica") == 0) & (F.col("w") == len(cuts) // 2) & (F.col("rule") < width - 1)).select("rule", F.col("n").cast("long").alias("n"), F.col("m").alias("mean"))
    named = spark.createDataFrame(list(enumerate(names)), "rule int, name string")
    found = named.join(middle, "rule", "left").join(tested.select("rule", F.col("true").alias("lift"), "p", "q"), "rule", "left")
    return found.select(F.col("name").alias("rule"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean", "lift", F.coalesce("p", F.lit(1.0)).alias("p"), "q")
