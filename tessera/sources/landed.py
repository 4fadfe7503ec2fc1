"""Landed feeds as Spark data sources: a format for each provider, read in batches or as a stream, a partition for each file, hosts filtered before anything is read.

A feed lands as files of JSON lines at <path>/<provider>/<host>/<name>, each line one document as its
provider sent it. A record is (host, file, nth, body); what is in the body is read by the provider's
own operator in feeds, on columns. Paths may be of any store that pyarrow knows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from . import feeds

SCHEMA = "host string, file string, nth long, body string"
#: Lines handed to Spark at once.
BATCH = 1024


@dataclass
class File(InputPartition):
    path: str
    host: str
    name: str


def _store(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str, provider: str, hosts: set[str] | None = None) -> list[File]:
    """The files of a provider in the order of their hosts and names; only of some hosts, where they are given."""
    from pyarrow import fs

    store, root = _store(path)
    out = []
    for folder in store.get_file_info(fs.FileSelector(f"{root}/{provider}", allow_not_found=True)):
        if folder.type == fs.FileType.Directory and (hosts is None or folder.base_name in hosts):
            found = store.get_file_info(fs.FileSelector(folder.path))
            out += [File(f.path, folder.base_name, f.base_name) for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
    return sorted(out, key=lambda f: (f.host, f.name))


def _lines(path: str, part: File) -> Iterator[pa.RecordBatch]:
    store, _ = _store(path)
    with store.open_input_stream(part.path) as raw, pa.PythonFile(raw, "r") as stream:
        bodies, nth = [], 0
        for line in _split(stream):
            bodies.append(line)
            if len(bodies) == BATCH:
                yield _batch(part, nth, bodies)
                nth, bodies = nth + len(bodies), []
        if bodies:
            yield _batch(part, nth, bodies)


def _split(stream: pa.PythonFile, size: int = 1 << 20) -> Iterator[str]:
    """Lines of a stream; blank ones are left out."""
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in whole if x.strip())
    if rest.strip():
        yield rest.decode("utf-8", "replace")


def _batch(part: File, nth: int, bodies: list[str]) -> pa.RecordBatch:
    n = len(bodies)
    return pa.RecordBatch.from_arrays([pa.array([part.host] * n), pa.array([part.name] * n), pa.array(range(nth, nth + n), pa.int64()), pa.array(bodies)], ["host", "file", "nth", "body"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, provider: str) -> None:
        self.path, self.provider, self.hosts = path, provider, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters of hosts; files of others aren't opened."""
        for f in filters:
            if isinstance(f, EqualTo | In) and tuple(f.attribute) == ("host",):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.hosts = some if self.hosts is None else self.hosts & some
            else:
                yield f

    def partitions(self) -> list[File]:
        return _files(self.path, self.provider, self.hosts) or [File("", "", "")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _lines(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are names of files, in order: a file lands whole, under a name beyond those of its host before it."""

    def __init__(self, path: str, provider: str) -> None:
        self.path, self.provider = path, provider

    def initialOffset(self) -> dict:
        return {"hosts": {}}

    def latestOffset(self) -> dict:
        return {"hosts": {f.host: f.name for f in _files(self.path, self.provider)}}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [f for f in _files(self.path, self.provider) if start["hosts"].get(f.host, "") < f.name <= end["hosts"].get(f.host, "")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        yield from _lines(self.path, partition)


class _Landed(DataSource):
    provider = ""

    @classmethod
    def name(cls) -> str:
        return f"tessera.{cls.provider}"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], self.provider)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self.provider)


#: A data source for each provider that is known.
SOURCES = {name: type(f"Landed_{name}", (_Landed,), {"provider": name}) for name in (*feeds.PROVIDERS, "stoneprofits")}


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("tessera.<provider>") known in the session; filters of hosts are pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES.values():
        spark.dataSource.register(source)


def provider(name: str | None) -> str:
    """The provider that a registry's entry names, the main connector without one; names that nobody knows are an error."""
    key = (name or "stoneprofits").strip().lower()
    if key not in SOURCES:
        raise KeyError(f"unknown provider {name!r}; known: {sorted(SOURCES)}")
    return key


def documents(spark: SparkSession, name: str | None, path: str) -> DataFrame:
    """(host, file, nth, body) of a provider's landed documents."""
    return spark.read.format(f"tessera.{provider(name)}").load(path)


def materials(spark: SparkSession, name: str | None, path: str) -> DataFrame:
    """What a provider's operator reads out of its landed documents; of the first in order of host, file and line, where documents repeat an item."""
    key = provider(name)
    docs = documents(spark, key, path)
    rank = F.struct("host", "file", "nth")
    if key == "umi":
        # branches and lots land as documents of one field each
        branches = docs.withColumn("json", F.get_json_object("body", "$.items")).where("json is not null").select(rank.alias("rank"), F.col("host").alias("branch"), "json")
        lots = docs.select(F.explode(F.from_json(F.get_json_object("body", "$.lots"), "array<struct<item:string,Qty:long,length:double,wide:double>>")).alias("l")).select("l.*")
        return feeds.umi(branches, lots)
    if key == "stonetrash":
        return feeds.stonetrash(docs.select(F.get_json_object("body", "$.id").alias("id"), F.col("body").alias("json")))
    if key == "unbuilt":
        return feeds.unbuilt(docs.select(rank.alias("rank"), F.col("body").alias("json")))
    if key == "iblocky":
        return feeds.iblocky(docs.select(F.get_json_object("body", "$.form").alias("form"), F.col("body").alias("json")))
    if key == "slabware":
        return feeds.slabware(docs.select("host", F.col("body").alias("json")))
    if key == "genericfeed":
        return feeds.products(docs.select(F.concat_ws("/", "host", F.get_json_object("body", "$.url")).alias("page_id"), F.get_json_object("body", "$.html").alias("html")))
    if key == "slabcloud":
        rows = docs.select("host", rank.alias("at"), F.get_json_object("body", "$.Name").alias("item_name"), F.get_json_object("body", "$.Thickness").alias("thickness"))
        return feeds.one_per_name(rows, "item_name", "at")
    return docs.select("host", F.get_json_object("body", "$.id").alias("item_id"), F.get_json_object("body", "$.name").alias("item_name"))
