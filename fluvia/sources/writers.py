"""Sinks: actions that end a flow."""

from __future__ import annotations

import queue as queues
from collections.abc import Callable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def for_each(df: DataFrame, f: Callable[[Any], None]) -> None:
    df.foreach(f)


def for_each_partition(df: DataFrame, f: Callable[[Any], None]) -> None:
    df.foreachPartition(f)


def run(df: DataFrame) -> None:
    """Runs a flow for its side effects alone."""
    df.write.format("noop").mode("overwrite").save()


def to_channel(df: DataFrame, channel: queues.Queue) -> None:
    """Sends rows to a queue one partition at a time, then None."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        channel.put(row)
    channel.put(None)


def write_csv(df: DataFrame, path: str, append: bool = False, one: bool = False, header: bool = True) -> None:
    (df.coalesce(1) if one else df).write.mode("append" if append else "overwrite").option("escape", '"').csv(path, header=header)


def write_parquet(df: DataFrame, path: str, append: bool = False, one: bool = False) -> None:
    (df.coalesce(1) if one else df).write.mode("append" if append else "overwrite").option("compression", "snappy").parquet(path)


def write_avro(df: DataFrame, path: str, append: bool = False, one: bool = False) -> None:
    from fluvia.sources import avro_files
    from fluvia.sources.readers import has_format

    if has_format(df.sparkSession, "avro"):
        (df.coalesce(1) if one else df).write.mode("append" if append else "overwrite").format("avro").save(path)
    else:
        avro_files.write(df, path, one)


class Writer:
    """A pluggable sink: one is made for each partition that is written."""

    def setup(self, partition: int) -> None: ...

    def write(self, row: Any) -> None: ...

    def flush(self) -> None: ...

    def finalize(self) -> None: ...


def write_with(df: DataFrame, make: Callable[[], Writer], rows_a_flush: int = 1000) -> None:
    """Sends each partition's rows through a writer of its own."""

    def run(rows: Any) -> None:
        from pyspark import TaskContext

        writer = make()
        writer.setup(TaskContext.get().partitionId())
        for k, row in enumerate(rows, 1):
            writer.write(row)
            if k % rows_a_flush == 0:
                writer.flush()
        writer.flush()
        writer.finalize()

    df.foreachPartition(run)


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None) -> Any:
    """df has a column value, and key if wanted. A streaming flow needs a checkpoint folder and gives its query."""
    from fluvia.sources.readers import _needs

    _needs(df.sparkSession, "kafka", "org.apache.spark:spark-sql-kafka-0-10_2.13")
    if df.isStreaming:
        return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()
    return df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


class CachedFlow:
    """Rows held for later flows: in memory, on disk, or as Parquet in a folder that all executors share."""

    def __init__(self, df: DataFrame, level: str = "memory", path: str | None = None):
        if level == "parquet":
            if not path:
                raise ValueError("a cache in Parquet needs a path")
            df.write.mode("overwrite").parquet(path)
            self.df = df.sparkSession.read.parquet(path)
        else:
            self.df = df.persist({"memory": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY}[level])

    def stream(self) -> Any:
        from fluvia.operators.flow import Flow

        return Flow(self.df)

    def collect(self) -> list:
        return self.df.collect()

    def drop(self) -> None:
        self.df.unpersist()
