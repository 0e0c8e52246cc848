"""Helpers that operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Expr = str | Column
#: A side of a join is only broadcast below this estimated size.
BROADCAST_BYTES = 64 << 20


def col(x: Expr) -> Column:
    return F.col(x) if isinstance(x, str) else x


def listed(x: Expr | list[Expr] | tuple[Expr, ...] | None) -> list[Expr]:
    if x is None:
        return []
    return list(x) if isinstance(x, list | tuple) else [x]


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a result's size; very large where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size allows; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def one_row(df: DataFrame) -> DataFrame:
    """A global aggregate, which has one row by construction, marked for broadcast."""
    return F.broadcast(df)


def memo(f: Callable, capacity: int) -> Callable:
    """f with a bounded cache that each Python worker keeps for itself."""
    return functools.lru_cache(maxsize=capacity)(f)


def _in_order(df: DataFrame, order_by: list[Expr]) -> DataFrame:
    """df range-partitioned and sorted, with the number of each row's partition in __part; persisted, so that a second pass
    sees the same partitions. Ties of the order are placed arbitrarily."""
    ordered = df.repartitionByRange(*map(col, order_by)).sortWithinPartitions(*order_by)
    return ordered.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).persist(StorageLevel.MEMORY_AND_DISK)


def dense_index(df: DataFrame, order_by: list[Expr], name: str) -> DataFrame:
    """df with a dense index from 0 by the given order, without sorting in one task.

    A first pass counts the rows of each range partition; the running sum of those few counts is added to each row's place
    in its partition.
    """
    placed = _in_order(df, order_by)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__row")).drop("__part", "__row", "__start", "__n")


def running_sums(df: DataFrame, order_by: list[Expr], sums: dict[str, Column]) -> DataFrame:
    """df with running sums over all rows in order, without sorting in one task: sums within range partitions, and those of
    the partitions before."""
    placed = _in_order(df.withColumns({f"__v_{k}": v for k, v in sums.items()}), order_by)
    totals = placed.groupBy("__part").agg(*(F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *(F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__s_{k}") for k in sums))
    own = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(starts), "__part")
    return out.withColumns({k: F.col(f"__s_{k}") + F.coalesce(F.sum(f"__v_{k}").over(own), F.lit(0)) for k in sums}).select(*df.columns, *sums)
