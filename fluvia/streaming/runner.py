"""Reading tables as streams, and running a query over all that is there now."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder, or a local one if none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{named}/{uuid.uuid4().hex}"


def read_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet file or folder `name` as a stream; its schema is taken from what is there."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_available(df: DataFrame, mode: str = "append", prepare: Callable[[Any], Any] | None = None) -> DataFrame:
    """Runs a streaming query over all input that is there, in batches, and gives its result as a table.

    Each batch is written as Parquet in the shared folder under its number, so a batch that is run again after a failure
    replaces itself. append keeps all batches; complete and update results are those of the last batch that had any.
    """
    spark, folder = df.sparkSession, shared(df.sparkSession)
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        last.append(number)

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep)
    query = (prepare(writer) if prepare else writer).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], df.schema)
    names = df.columns
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(f"{folder}/out/batch={last[-1]}")
    return spark.read.schema(df.schema).parquet(*[f"{folder}/out/batch={k}" for k in sorted(set(last))]).select(*names)
