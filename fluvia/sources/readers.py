"""Sources as DataFrames."""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterable, Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of a pandas frame that a generating source makes at a time.
CHUNK = 8192


def from_rows(spark: SparkSession, rows: Iterable[Any], schema: str) -> DataFrame:
    """Rows of the driver program, one partition, in their order."""
    return spark.createDataFrame(list(rows), schema).coalesce(1)


def from_generator(spark: SparkSession, make: Callable[[int, int], Iterable[tuple]], schema: str, peers: int) -> DataFrame:
    """make(index, peers) makes the rows of each of `peers` partitions, where they are needed."""
    names = StructType.fromDDL(schema).names

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for index in part["id"]:
                rows = iter(make(int(index), peers))
                while chunk := list(islice(rows, CHUNK)):
                    yield pd.DataFrame(chunk, columns=names)

    return spark.range(0, peers, 1, peers).mapInPandas(run, schema)


def from_async(spark: SparkSession, make: Callable[[], AsyncIterable[tuple]], schema: str) -> DataFrame:
    """The rows of an asynchronous iterator, which one task drains."""

    def drain(index: int, peers: int) -> Iterator[tuple]:
        loop = asyncio.new_event_loop()
        rows = make().__aiter__()
        try:
            while True:
                try:
                    yield loop.run_until_complete(rows.__anext__())
                except StopAsyncIteration:
                    return
        finally:
            loop.close()

    return from_generator(spark, drain, schema, 1)


def from_channel(spark: SparkSession, queue: Any, schema: str) -> DataFrame:
    """What a queue of the driver program holds until a None. The rows live in the driver, as the queue's do."""
    return from_rows(spark, iter(queue.get, None), schema)


def csv(
    spark: SparkSession, path: str, schema: str, *, has_headers: bool = True, delimiter: str = ",", quote: str = '"', double_quote: bool = True, escape: str | None = None,
    quoting: bool = True, comment: str | None = None, terminator: str | None = None, trim: bool = False, flexible: bool = False, multiline: bool = False,
) -> DataFrame:
    """Typed rows. A malformed row fails the query, unless rows may differ in length (flexible)."""
    r = spark.read.schema(schema).option("header", has_headers).option("sep", delimiter).option("mode", "PERMISSIVE" if flexible else "FAILFAST").option("enforceSchema", True)
    r = r.option("quote", quote if quoting else "").option("multiLine", multiline)
    if escape or double_quote:
        r = r.option("escape", escape or quote)
    if comment:
        r = r.option("comment", comment)
    if terminator:
        r = r.option("lineSep", terminator)
    if trim:
        r = r.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return r.csv(path)


def _needs(spark: SparkSession, fmt: str, package: str) -> None:
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(fmt, spark._jsparkSession.sessionState().conf())
    except Exception as e:
        raise RuntimeError(f"the {fmt} source needs the package {package} on Spark's class path (spark.jars.packages)") from e


def has_format(spark: SparkSession, fmt: str) -> bool:
    try:
        _needs(spark, fmt, "")
    except RuntimeError:
        return False
    return True


def avro(spark: SparkSession, path: str) -> DataFrame:
    """Avro files, by Spark's own package where it is there."""
    if has_format(spark, "avro"):
        return spark.read.format("avro").load(path)
    from fluvia.sources import avro_files

    return avro_files.read(spark, path)


def kafka(spark: SparkSession, servers: str, topics: list[str], streaming: bool = True, **options: str) -> DataFrame:
    """Keys, values and offsets of topics; a checkpoint makes what is read exactly-once."""
    _needs(spark, "kafka", "org.apache.spark:spark-sql-kafka-0-10_2.13")
    r = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    return r.options(**options).load()


class GeneratorSource(DataSource):
    """A pluggable source: spark.read.format("fluvia_range") makes the whole numbers of a range, in partitions."""

    @classmethod
    def name(cls) -> str:
        return "fluvia_range"

    def schema(self) -> str:
        return "value bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RangeReader({k.lower(): v for k, v in self.options.items()})


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.start, self.end, self.peers = int(options.get("start", 0)), int(options["end"]), int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.peers)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        chunk = -(-max(0, self.end - self.start) // self.peers)
        low = self.start + partition.value * chunk
        for x in range(low, min(self.end, low + chunk)):
            yield (x,)
