"""What the operators of this subpackage share: tables, checkpoints, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch between the JVM and Python; both sides hold a batch of each task, and texts can be long.
BATCH_ROWS = 2000
#: Rows that one step of a Python operator holds at a time, besides the Arrow batch they come from.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir. A local session without one gets one of its own;
    on a cluster a machine-local folder would lose data, so there it has to be named."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared checkpoint folder, without its lineage.

    Unlike checkpoint(), which keeps the size that the optimizer guessed for the plan, a table tells its real size; guesses of loops
    of joins multiply each round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").parquet(path)  # mostly hashes, of which no dictionary can be made
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def written(df: DataFrame) -> DataFrame:
    """As checkpointed, after a step that shuffles much: Spark drops the shuffle files of a plan that nothing refers to when the
    driver collects its garbage, which is asked for here, so that steps don't add up on disk."""
    out = checkpointed(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `checkpointed` or `written` that no later plan reads."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold BATCH_ROWS at most, unless the session names a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Returns what a Python worker has freed to the system; workers stay, and other tasks need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_slices(df: DataFrame, columns: list[str], schema: str, work: Callable[[dict[str, list]], dict[str, list]], rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow over the given columns alone, some rows at a time, so that memory is bounded by the longest rows.

    work gets {column: values} and returns {column: values} by the names and types of schema (a DDL string).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = work({name: part.column(k).to_pylist() for k, name in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in target], schema=target)
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; component is the smallest node reachable.

    Alternates large-star and small-star steps. A node's smallest neighbour is a map-side combined minimum, written out before it
    is joined back: both sides of that join are shuffled for it alone, so AQE deals the edges of a node with very many to several
    tasks. Each round is written to the checkpoint folder.
    Self-loops and repeated edges are allowed; an edge with a null end is ignored. No edges give no rows.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpointed(both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        before, e = e, checkpointed(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct())
        forget(before, near, large, low)
        # settled once every edge leads to a node that leads nowhere: each component is a star around its smallest node
        if e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and e.count() == e.select("u").distinct().count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
