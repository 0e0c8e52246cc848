"""The entry point: a context that makes flows from sources."""

from __future__ import annotations

from collections.abc import AsyncIterable, Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from fluvia.config import RuntimeConfig
from fluvia.operators.flow import Flow
from fluvia.sources import readers


class FlowContext:
    """Makes flows on a Spark session. Unlike a one-shot job graph it lives on: every action runs its own job."""

    def __init__(self, spark: SparkSession | None = None, config: RuntimeConfig | None = None):
        self.config = config or RuntimeConfig.local()
        self.spark = spark or self.config.session()

    @classmethod
    def local(cls, threads: int | None = None) -> FlowContext:
        return cls(config=RuntimeConfig.local(threads))

    @property
    def parallelism(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    def stream(self, df: DataFrame, ts: str | None = None) -> Flow:
        return Flow(df, ts)

    def stream_iter(self, rows: Iterable[Any], schema: str) -> Flow:
        return Flow(readers.from_rows(self.spark, rows, schema))

    def stream_range(self, start: int, end: int, partitions: int | None = None) -> Flow:
        return Flow(self.spark.range(start, end, 1, partitions or self.parallelism))

    def stream_par_iter(self, make: Callable[[int, int], Iterable[tuple]], schema: str, peers: int | None = None) -> Flow:
        return Flow(readers.from_generator(self.spark, make, schema, peers or self.parallelism))

    def stream_async(self, make: Callable[[], AsyncIterable[tuple]], schema: str) -> Flow:
        return Flow(readers.from_async(self.spark, make, schema))

    def stream_channel(self, queue: Any, schema: str) -> Flow:
        return Flow(readers.from_channel(self.spark, queue, schema))

    def stream_file(self, path: str) -> Flow:
        return Flow(self.spark.read.text(path))

    def stream_csv(self, path: str, schema: str, **options: Any) -> Flow:
        return Flow(readers.csv(self.spark, path, schema, **options))

    def stream_parquet(self, path: str) -> Flow:
        return Flow(self.spark.read.parquet(path))

    def stream_avro(self, path: str) -> Flow:
        return Flow(readers.avro(self.spark, path))

    def stream_kafka(self, servers: str, topics: list[str], **options: str) -> Flow:
        return Flow(readers.kafka(self.spark, servers, topics, **options))
