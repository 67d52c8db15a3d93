"""Resumable ingestion: a stream over pages whose offset is the page cursor, and a sink that applies each batch once.

A page is a folder ``cursor=<cursor>`` with one JSON file of ``rows`` and the cursor of the page after it (``last``), as paged
interfaces give them. Spark's checkpoint holds the cursor up to which pages are taken; a restarted query asks for the
pages from there. The sink keeps a ledger: one file for each applied batch with the digest of its rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources.tables import content_key, replace_days, upsert

TRADES = "symbol string, seq long, sec long, price double, volume double, side string"


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _page(folder: str, cursor: str) -> dict | None:
    """The page at a cursor, or None where it isn't there yet. A page that can't be read ends the query."""
    from pyarrow import fs

    system, path = _system(folder)
    found = [x.path for x in system.get_file_info(fs.FileSelector(f"{path}/cursor={cursor}", allow_not_found=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
    if not found:
        return None
    if len(found) > 1:
        raise ValueError(f"page {cursor} has several files")
    with system.open_input_file(found[0]) as file:
        return json.loads(file.read())


#: A page's end that tells the next cursor; a page that is written in another order is parsed.
_END = re.compile(rb'"last"\s*:\s*("[^"\\]*"|-?\d+)\s*\}\s*\Z')


def _order(cursor: str) -> tuple[int, str]:
    return len(cursor), cursor


def _next(folder: str, cursor: str, file) -> str:
    """The cursor after a page, from the end of its file."""
    with _system(folder)[0].open_input_file(file.path) as data:
        data.seek(max(0, file.size - 256))
        found = _END.search(data.read())
    return str(json.loads(found[1]) if found else _page(folder, cursor)["last"])


def _following(folder: str, start: str, end: str) -> dict[str, str]:
    """The next cursor of each page from start on, before end: one listing, then the ends of the files, several at a time."""
    from pyarrow import fs

    system, path = _system(folder)
    files: dict[str, list] = {}
    for x in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        name = x.path.rsplit("/", 2)[1].removeprefix("cursor=")
        if x.is_file and f"/cursor={name}/" in x.path and not x.base_name.startswith(("_", ".")) and _order(start) <= _order(name) < _order(end):
            files.setdefault(name, []).append(x)
    for name, held in files.items():
        if len(held) > 1:
            raise ValueError(f"page {name} has several files")
    with ThreadPoolExecutor(16) as pool:
        return dict(zip(files, pool.map(lambda name: _next(folder, name, files[name][0]), files), strict=True))


def _newest(folder: str) -> str | None:
    from pyarrow import fs

    system, path = _system(folder)
    names = [x.base_name.removeprefix("cursor=") for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.base_name.startswith("cursor=")]
    return max(names, key=lambda x: (len(x), x), default=None)


class Page(InputPartition):
    """A page, and what comes after it in the same task."""

    def __init__(self, cursor: str, *more: str):
        self.cursor, self.cursors = cursor, (cursor, *more)


class PagesReader(DataSourceStreamReader):
    def __init__(self, folder: str, first: str, at_once: int, names: list[str]):
        self.folder, self.first, self.at_once, self.names = folder, first, at_once, names
        self.upto: str | None = None

    def initialOffset(self) -> dict:
        return {"cursor": self.first}

    def latestOffset(self) -> dict:
        """The end of the newest page when a query begins, then at most ``at_once`` pages beyond the last answer; a page that names itself as the next one is no progress."""
        if self.upto is None:
            newest = _newest(self.folder)
            self.upto = self.first if newest is None else str(_page(self.folder, newest)["last"])
            return {"cursor": self.upto}
        for _ in range(self.at_once):
            page = _page(self.folder, self.upto)
            if page is None or str(page["last"]) == self.upto:
                break
            self.upto = str(page["last"])
        return {"cursor": self.upto}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        """The pages from start on, before end: a partition each, or, of many, runs of up to 64 pages."""
        found, cursor = [], start["cursor"]
        after = _following(self.folder, cursor, end["cursor"]) if cursor != end["cursor"] else {}
        while cursor != end["cursor"]:
            if cursor not in after:
                raise FileNotFoundError(f"page {cursor} is missing")
            found.append(cursor)
            cursor = after[cursor]
        self.upto = max(self.upto or cursor, cursor, key=lambda x: (len(x), x))  # of a batch that is planned again after a restart
        run = min(64, -(-len(found) // 256) or 1)
        return [Page(*found[k : k + run]) for k in range(0, len(found), run)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for cursor in partition.cursors:
            for row in _page(self.folder, cursor)["rows"]:
                yield tuple(row.get(name) for name in self.names)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint is all that is kept."""


class Pages(DataSource):
    """Options: path (with its file system), first (the first cursor), pages (at most, in a micro-batch but the first of a run). Cursors grow in length, then in order."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return TRADES

    def streamReader(self, schema) -> PagesReader:
        return PagesReader(self.options["path"], self.options.get("first", "0"), int(self.options.get("pages", "20")), schema.names)


def paged(spark: SparkSession, folder: str, first: str = "0", pages: int = 20, schema: str = TRADES) -> DataFrame:
    """The rows of all pages from ``first`` on, in micro-batches of so many pages."""
    spark.dataSource.register(Pages)
    return spark.readStream.format("pages").schema(schema).option("path", folder).option("first", first).option("pages", str(pages)).load()


class UnsafeState(RuntimeError):
    """The ledger can't be trusted; nothing is written until somebody has looked at it."""


class Ledger:
    """The digests of the applied batches, a file of one line for each: 0.json, 1.json, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def digest(self, batch: int) -> str | None:
        """The digest of a batch, None if it isn't applied yet. An unreadable entry, or one without its predecessor, is unsafe."""
        system, path = self._hadoop(f"{self.folder}/{batch}.json")
        if batch and not self._hadoop(f"{self.folder}/{batch - 1}.json")[0].exists(self._hadoop(f"{self.folder}/{batch - 1}.json")[1]):
            raise UnsafeState(f"batch {batch - 1} is missing from the ledger")
        if not system.exists(path):
            return None
        try:
            entry = json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])
            if entry["batch"] != batch:
                raise ValueError("another batch's entry")
            return str(entry["digest"])
        except Exception as error:
            raise UnsafeState(f"the ledger's entry of batch {batch} can't be read") from error

    def add(self, batch: int, digest: str) -> None:
        """Written beside and moved into place, so a broken write leaves no entry."""
        system, path = self._hadoop(f"{self.folder}/{batch}.json")
        beside = self._hadoop(f"{self.folder}/.{batch}.json.new")[1]
        out = system.create(beside, True)
        out.write(bytearray(json.dumps({"batch": batch, "digest": digest}).encode()))
        out.close()
        if not system.rename(beside, path):
            raise UnsafeState(f"batch {batch} was applied by somebody else")


def applied_once(table: str, ledger: str):
    """For foreachBatch: merges the batch's bars (symbol, time) into a table by symbol and day, once for each batch id; only the days of the batch are written.

    A batch that comes again with the same rows changes nothing; one that comes again with others, or a damaged
    ledger, raises UnsafeState and ends the query. The table is written before the ledger, and writing the same days again gives the same table,
    so a failure between the two is repaired by the next run.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = batch.persist()
        try:
            book, digest = Ledger(spark, ledger), content_key(held)
            known = book.digest(number)
            if known == digest:
                return
            if known is not None:
                raise UnsafeState(f"batch {number} came again with other rows")
            system, path = book._hadoop(table)
            merged = held
            if system.exists(path):
                days = held.select("symbol", F.floor(F.col("time") / 86400).alias("day")).distinct()
                stored = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*held.schema]) + ", day long").parquet(table)
                merged = upsert(stored.join(days, ["symbol", "day"], "left_semi").select(*held.columns), held, ["symbol", "time"])
            replace_days(merged, table)
            book.add(number, digest)
        finally:
            held.unpersist()

    return apply
