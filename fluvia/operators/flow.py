"""Flow: a DataFrame with dataflow operators, and KeyedFlow: one whose rows belong to keys."""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.operators import iteration, joins
from fluvia.operators.base import Expr, col, dense_index, listed, memo, one_row, running_sums
from fluvia.sources import writers


class Flow:
    """Rows, and the name of their event-time column where they have one. `.df` is the plan so far.

    Every operator takes Column expressions; those that take Python functions say so in their names. Operators whose result
    depends on the order of rows take order_by, which should end in something unique.
    """

    def __init__(self, df: DataFrame, ts: str | None = None):
        self.df, self.ts = df, ts

    def _as(self, df: DataFrame) -> Flow:
        return Flow(df, self.ts if self.ts in df.columns else None)

    # ---- stateless -------------------------------------------------------------------------------------------

    def map(self, *exprs: Expr, **named: Expr) -> Flow:
        return self._as(self.df.select(*exprs, *(col(v).alias(k) for k, v in named.items())))

    def with_columns(self, **named: Expr) -> Flow:
        return self._as(self.df.withColumns({k: col(v) for k, v in named.items()}))

    def filter(self, condition: Expr) -> Flow:
        return self._as(self.df.where(condition))

    def filter_map(self, expr: Column, name: str) -> Flow:
        """expr's value where it isn't null."""
        return self._as(self.df.select(expr.alias(name)).where(F.col(name).isNotNull()))

    def flat_map(self, array: Column, name: str, *keep: Expr) -> Flow:
        """A row for each item of an array expression; an empty or null one gives none."""
        return self._as(self.df.select(*keep, F.explode(array).alias(name)))

    def flatten(self, column: str, *keep: Expr) -> Flow:
        return self.flat_map(F.col(column), column, *keep)

    def inspect(self, name: str, *metrics: Column) -> Flow:
        """Aggregates to observe as the rows pass; see pyspark.sql.Observation."""
        return self._as(self.df.observe(name, *metrics))

    def map_pandas(self, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> Flow:
        return self._as(self.df.mapInPandas(f, schema))

    def map_arrow(self, f: Callable, schema: str) -> Flow:
        return self._as(self.df.mapInArrow(f, schema))

    def add_operator(self, f: Callable[[DataFrame], DataFrame]) -> Flow:
        """A custom operator: any function of DataFrames."""
        return self._as(f(self.df))

    def map_memo(self, f: Callable[[Any], Any], column: str, name: str, returns: str, capacity: int = 100_000) -> Flow:
        """A column by a Python function whose results are kept, up to `capacity` in each worker."""
        return self.map_memo_by(f, column, column, name, returns, capacity)

    def map_memo_by(self, f: Callable[[Any], Any], column: str, key: Expr, name: str, returns: str, capacity: int = 100_000) -> Flow:
        """As map_memo, but rows of the same key get the result of the first seen. f must not differ within a key, else
        which result a row gets depends on where it ran."""

        @F.pandas_udf(returns)
        def cached(keys: pd.Series, values: pd.Series) -> pd.Series:
            held = _memo_store(f, capacity)
            out = []
            for k, v in zip(keys, values, strict=True):
                held.value = v
                out.append(held(k))
            return pd.Series(out)

        return self._as(self.df.withColumn(name, cached(col(key), F.col(column))))

    def map_async(self, f: Callable[[Any], Any], column: str, name: str, returns: str, in_flight: int = 4) -> Flow:
        """A column by an asynchronous Python function; so many are in flight at a time, and the order of rows stays."""

        @F.pandas_udf(returns)
        def awaited(values: pd.Series) -> pd.Series:
            async def every() -> list:
                gate = asyncio.Semaphore(in_flight)

                async def one(v: Any) -> Any:
                    async with gate:
                        return await f(v)

                return await asyncio.gather(*map(one, values))

            return pd.Series(asyncio.run(every()))

        return self._as(self.df.withColumn(name, awaited(F.col(column))))

    def map_async_memo(self, f: Callable[[Any], Any], column: str, name: str, returns: str, in_flight: int = 4) -> Flow:
        """As map_async, once for each different value of the column."""
        held = Flow(self.df.select(column).distinct()).map_async(f, column, name, returns, in_flight).df
        return self._as(self.df.join(held.withColumnRenamed(column, "__by"), F.col(column).eqNullSafe(F.col("__by"))).drop("__by"))

    def into_boxed(self) -> Flow:
        return self

    def batch_mode(self, mode: str = "adaptive") -> Flow:
        """Batching between stages is Spark's; results don't depend on it. mode: single, fixed, adaptive or timed."""
        if mode not in ("single", "fixed", "adaptive", "timed"):
            raise ValueError(f"no such batch mode: {mode}")
        return self

    # ---- stateful over all rows --------------------------------------------------------------------------------

    def rich_map(self, order_by: Expr | list[Expr], **running: Column) -> Flow:
        """Running aggregates or window functions over all rows so far, by order.

        One global order of any aggregate is one task's work; running_sums and enumerate do sums, counts and numbers in parallel.
        """
        w = Window.orderBy(*listed(order_by))
        return self._as(self.df.withColumns({k: v.over(w) for k, v in running.items()}))

    def running_sums(self, order_by: Expr | list[Expr], **sums: Column) -> Flow:
        """Running sums over all rows in order; nothing is sorted in one task."""
        return self._as(running_sums(self.df, listed(order_by), sums))

    def rich_filter_map(self, order_by: Expr | list[Expr], condition: Column, **running: Column) -> Flow:
        return self.rich_map(order_by, **running).filter(condition)

    def enumerate(self, order_by: Expr | list[Expr], name: str = "index") -> Flow:
        """A dense index from 0, without sorting in one task."""
        return self._as(dense_index(self.df, listed(order_by), name))

    def rich_map_custom(self, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, order_by: Expr | list[Expr] | None = None) -> Flow:
        """A function with state over the rows of each partition, sorted if an order is given."""
        df = self.df.sortWithinPartitions(*listed(order_by)) if order_by else self.df
        return self._as(df.mapInPandas(f, schema))

    rich_flat_map = rich_map_custom

    # ---- keys and places ---------------------------------------------------------------------------------------

    def group_by(self, *keys: Expr, **named: Expr) -> KeyedFlow:
        """Rows with their keys; what follows decides whether and when they are shuffled."""
        df = self.df.withColumns({k: col(v) for k, v in named.items()}) if named else self.df
        exprs = [k for k in keys if not isinstance(k, str)]
        df = df.select("*", *exprs) if exprs else df
        names = [k if isinstance(k, str) else df.columns[len(df.columns) - len(exprs) + exprs.index(k)] for k in keys]
        return KeyedFlow(df, [*names, *named], self.ts)

    def key_by(self, *keys: Expr, per_partition: bool = False, **named: Expr) -> KeyedFlow:
        """As group_by; with per_partition a key's rows only meet those of the same partition."""
        if per_partition:
            named = {"partition": F.spark_partition_id(), **named}
        return self.group_by(*keys, **named)

    def to_keyed(self, *keys: str) -> KeyedFlow:
        return KeyedFlow(self.df, list(keys), self.ts)

    def shuffle(self, partitions: int | None = None) -> Flow:
        return self._as(self.df.repartition(partitions or self.df.sparkSession.sparkContext.defaultParallelism))

    def broadcast(self, copies: int) -> Flow:
        """Every row `copies` times, as many replicas would see it."""
        return self._as(self.df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))))

    def replication(self, most: int) -> Flow:
        return self._as(self.df.coalesce(most))

    def repartition_by(self, partitions: int, *exprs: Expr) -> Flow:
        return self._as(self.df.repartition(partitions, *map(col, exprs)))

    def split(self, n: int) -> list[Flow]:
        return [self] * n

    def route(self) -> Router:
        return Router(self)

    # ---- sets --------------------------------------------------------------------------------------------------

    def merge(self, other: Flow) -> Flow:
        return self._as(self.df.unionByName(other.df))

    def merge_distinct(self, other: Flow) -> Flow:
        """Rows of either type: side L or R, and a struct of each."""
        a = self.df.select(F.lit("L").alias("side"), F.struct("*").alias("left")).withColumn("right", F.lit(None).cast(other.df.schema))
        b = other.df.select(F.lit("R").alias("side"), F.lit(None).cast(self.df.schema).alias("left"), F.struct("*").alias("right"))
        return Flow(a.unionByName(b))

    def unique_assoc(self) -> Flow:
        return self._as(self.df.distinct())

    def unique_assoc_by_key(self, keys: str | list[str], order_by: Expr | list[Expr] | None = None) -> Flow:
        """One row for each key: the first by order, or any."""
        keys = listed(keys)
        if order_by is None:
            return self._as(self.df.dropDuplicates(keys))
        first = F.min_by(F.struct(*self.df.columns), F.struct(*map(col, listed(order_by))))
        return self._as(self.df.groupBy(*keys).agg(first.alias("__first")).select("__first.*"))

    def zip(self, other: Flow, order_by: Expr | list[Expr], other_order_by: Expr | list[Expr]) -> Flow:
        """The i-th row of each side together, up to the shorter side."""
        a, b = dense_index(self.df, listed(order_by), "__i"), dense_index(other.df, listed(other_order_by), "__i")
        return self._as(a.join(b, "__i").drop("__i"))

    # ---- over all rows -----------------------------------------------------------------------------------------

    def fold(self, *aggregates: Column) -> Flow:
        """Aggregates of all rows; no row if there are none."""
        return Flow(self.df.agg(*aggregates, F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n"))

    fold_assoc = reduce = reduce_assoc = fold

    def fold_pandas(self, local: Callable[[pd.DataFrame], pd.DataFrame], final: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Flow:
        """Any associative fold: `local` makes a few rows of each batch, `final` one result of all of those."""

        def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None
            for part in parts:
                if len(part):
                    now = local(part)
                    held = now if held is None else final(pd.concat([held, now], ignore_index=True))
            if held is not None:
                yield held

        def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = [p for p in parts if len(p)]
            if got:
                yield final(pd.concat(got, ignore_index=True))

        return Flow(self.df.mapInPandas(partial, schema).coalesce(1).mapInPandas(whole, schema))

    def fold_scan(self, aggregates: list[Column], *exprs: Expr) -> Flow:
        """Aggregates of all rows beside every row."""
        return self._as(self.df.crossJoin(one_row(self.df.agg(*aggregates))).select(*(exprs or ["*"])))

    reduce_scan = fold_scan

    def collect_count(self) -> int:
        return self.df.count()

    def count_row(self, name: str = "count") -> Flow:
        return Flow(self.df.agg(F.count(F.lit(1)).alias(name)))

    # ---- by key, in two phases ---------------------------------------------------------------------------------

    def group_by_fold(self, keys: Expr | list[Expr], *aggregates: Column) -> KeyedFlow:
        return self.group_by(*listed(keys)).fold(*aggregates)

    group_by_reduce = group_by_fold

    def group_by_sum(self, keys: Expr | list[Expr], value: Expr, name: str = "sum") -> KeyedFlow:
        return self.group_by_fold(keys, F.sum(value).alias(name))

    def group_by_avg(self, keys: Expr | list[Expr], value: Expr, name: str = "avg") -> KeyedFlow:
        return self.group_by_fold(keys, F.avg(value).alias(name))

    def group_by_count(self, keys: Expr | list[Expr], name: str = "count") -> KeyedFlow:
        return self.group_by_fold(keys, F.count(F.lit(1)).alias(name))

    def group_by_max_element(self, keys: Expr | list[Expr], value: Expr, tiebreak: Expr) -> KeyedFlow:
        """The whole row of the largest value; of equals that of the smallest tiebreak, which has to be a number."""
        return self._element(keys, F.max_by(F.struct("*"), F.struct(col(value).alias("v"), (-col(tiebreak)).alias("t"))))

    def group_by_min_element(self, keys: Expr | list[Expr], value: Expr, tiebreak: Expr) -> KeyedFlow:
        return self._element(keys, F.min_by(F.struct("*"), F.struct(col(value).alias("v"), col(tiebreak).alias("t"))))

    def _element(self, keys: Expr | list[Expr], chosen: Column) -> KeyedFlow:
        keyed = self.group_by(*listed(keys))
        return KeyedFlow(keyed.df.groupBy(*keyed.keys).agg(chosen.alias("__e")).select("__e.*"), keyed.keys, self.ts)

    # ---- joins -------------------------------------------------------------------------------------------------

    def join_with(self, right: Flow, left_key: Expr | list[Expr], right_key: Expr | list[Expr], null_safe: bool = False) -> joins.JoinBuilder:
        return joins.JoinBuilder(self.df, right.df, listed(left_key), listed(right_key), null_safe)

    def join(self, right: Flow, left_key: Expr | list[Expr], right_key: Expr | list[Expr]) -> Flow:
        return Flow(self.join_with(right, left_key, right_key).inner())

    def left_join(self, right: Flow, left_key: Expr | list[Expr], right_key: Expr | list[Expr]) -> Flow:
        return Flow(self.join_with(right, left_key, right_key).left())

    def outer_join(self, right: Flow, left_key: Expr | list[Expr], right_key: Expr | list[Expr]) -> Flow:
        return Flow(self.join_with(right, left_key, right_key).outer())

    def interval_join(self, right: Flow, left_ts: str, right_ts: str, lower: int, upper: int) -> Flow:
        """Pairs with left - lower <= right <= left + upper, bounds included; times are whole numbers."""
        return Flow(joins.interval_join(self.df, right.df, [], [], left_ts, right_ts, lower, upper))

    # ---- windows -----------------------------------------------------------------------------------------------

    def window_all(self, window: Any) -> Any:
        from fluvia.operators.windows import WindowedFlow

        return WindowedFlow(self.df, [], window, self.ts)

    # ---- order -------------------------------------------------------------------------------------------------

    def sorted_by(self, *order_by: Expr, scope: str = "global") -> Flow:
        return self._as(self.df.orderBy(*order_by) if scope == "global" else self.df.sortWithinPartitions(*order_by))

    def limit(self, n: int, offset: int = 0, order_by: Expr | list[Expr] | None = None) -> Flow:
        df = self.df.orderBy(*listed(order_by)) if order_by else self.df
        return self._as((df.offset(offset) if offset else df).limit(n))

    def sorted_limit_by(self, order_by: Expr | list[Expr], n: int, offset: int = 0) -> Flow:
        return self.limit(n, offset, order_by)

    def reorder(self, ts: str | None = None) -> Flow:
        """Rows of each partition in the order of their times."""
        return self._as(self.df.sortWithinPartitions(ts or self.ts))

    # ---- time --------------------------------------------------------------------------------------------------

    def add_timestamps(self, ts: Expr, name: str = "ts", delay: str | None = None) -> Flow:
        """An event-time column; with a delay a watermark too: rows older than the newest less the delay may be dropped."""
        df = self.df.withColumn(name, col(ts))
        return Flow(df.withWatermark(name, delay) if delay else df, name)

    def drop_timestamps(self) -> Flow:
        return Flow(self.df.drop(self.ts) if self.ts else self.df)

    # ---- loops -------------------------------------------------------------------------------------------------

    def iterate(self, rounds: int, state: Any, body: Callable, local_fold: Callable, global_fold: Callable, condition: Callable | None = None) -> tuple[Any, Flow]:
        state, df = iteration.iterate(self.df, rounds, state, body, local_fold, global_fold, condition)
        return state, Flow(df)

    def replay(self, rounds: int, state: Any, body: Callable, local_fold: Callable, global_fold: Callable, condition: Callable | None = None) -> Any:
        return iteration.replay(self.df, rounds, state, body, local_fold, global_fold, condition)

    # ---- ends --------------------------------------------------------------------------------------------------

    def for_each(self, f: Callable[[Any], None]) -> None:
        writers.for_each(self.df, f)

    def collect_vec(self) -> list:
        return self.df.collect()

    def collect(self, into: Callable[[list], Any] = list) -> Any:
        return into(self.df.collect())

    def collect_all(self, most: int = 1_000_000) -> Any:
        """The rows on every executor; a result of more than `most` rows is refused rather than gathered."""
        rows = self.df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} rows for every executor")
        return self.df.sparkSession.sparkContext.broadcast(rows)

    def collect_channel(self, channel: Any) -> None:
        writers.to_channel(self.df, channel)

    def cache(self, level: str = "memory", path: str | None = None) -> Flow:
        return self._as(writers.CachedFlow(self.df, level, path).df)

    def collect_cache(self, level: str = "memory", path: str | None = None) -> writers.CachedFlow:
        held = writers.CachedFlow(self.df, level, path)
        writers.run(held.df)
        return held

    def write_csv(self, path: str, append: bool = False, one: bool = False) -> None:
        writers.write_csv(self.df, path, append, one)

    def write_parquet(self, path: str, append: bool = False, one: bool = False) -> None:
        writers.write_parquet(self.df, path, append, one)

    def write_avro(self, path: str, append: bool = False, one: bool = False) -> None:
        writers.write_avro(self.df, path, append, one)

    def write_with(self, make: Callable[[], writers.Writer], rows_a_flush: int = 1000) -> None:
        writers.write_with(self.df, make, rows_a_flush)

    def write_kafka(self, servers: str, topic: str, checkpoint: str | None = None) -> Any:
        return writers.write_kafka(self.df, servers, topic, checkpoint)


class KeyedFlow(Flow):
    """A flow whose rows belong to keys: the named columns."""

    def __init__(self, df: DataFrame, keys: list[str], ts: str | None = None):
        super().__init__(df, ts)
        self.keys = keys

    def _as(self, df: DataFrame) -> KeyedFlow:
        return KeyedFlow(df, self.keys, self.ts if self.ts in df.columns else None)

    def map(self, *exprs: Expr, **named: Expr) -> KeyedFlow:
        return self._as(self.df.select(*self.keys, *exprs, *(col(v).alias(k) for k, v in named.items())))

    def filter_map(self, expr: Column, name: str) -> KeyedFlow:
        return self._as(self.df.select(*self.keys, expr.alias(name)).where(F.col(name).isNotNull()))

    def flat_map(self, array: Column, name: str, *keep: Expr) -> KeyedFlow:
        return self._as(self.df.select(*self.keys, *keep, F.explode(array).alias(name)))

    def unkey(self) -> Flow:
        return Flow(self.df, self.ts)

    def drop_key(self) -> Flow:
        return Flow(self.df.drop(*self.keys), self.ts)

    def shuffle(self, partitions: int | None = None) -> Flow:
        return self.unkey().shuffle(partitions)

    def _window(self, order_by: Expr | list[Expr] | None = None) -> Any:
        w = Window.partitionBy(*self.keys)
        return w.orderBy(*listed(order_by)) if order_by else w

    def rich_map(self, order_by: Expr | list[Expr], **running: Column) -> KeyedFlow:
        """Running aggregates or window functions over a key's rows so far, by order."""
        w = self._window(order_by)
        return self._as(self.df.withColumns({k: v.over(w) for k, v in running.items()}))

    def rich_map_pandas(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order_by: list[str]) -> KeyedFlow:
        """Any function with state of a key's rows in order. A key's rows are held together, so this is for keys of a known
        size; the JVM forms have no such bound."""

        def run(part: pd.DataFrame) -> pd.DataFrame:
            return f(part.sort_values(order_by, kind="stable").reset_index(drop=True))

        return KeyedFlow(self.df.groupBy(*self.keys).applyInPandas(run, schema), self.keys)

    rich_filter_map_pandas = rich_flat_map_pandas = rich_map_pandas

    def rich_map_custom(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order_by: list[str] | None = None) -> Flow:
        return self.rich_map_pandas(f, schema, order_by or []).unkey()

    def fold(self, *aggregates: Column) -> KeyedFlow:
        return KeyedFlow(self.df.groupBy(*self.keys).agg(*aggregates), self.keys)

    reduce = fold

    def fold_ordered(self, value: Column, order_by: Expr | list[Expr], init: Column, merge: Callable[[Column, Column], Column], name: str) -> KeyedFlow:
        """A fold of a key's values in order, in the JVM: they are gathered, sorted and folded as an array."""
        rows = F.array_sort(F.collect_list(F.struct(*(col(o).alias(f"o{k}") for k, o in enumerate(listed(order_by))), value.alias("v"))))
        return self.fold(F.aggregate(F.transform(rows, lambda r: r["v"]), init, merge).alias(name))

    def fold_pandas(self, local: Callable[[pd.DataFrame], pd.DataFrame], final: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> KeyedFlow:
        """Any associative fold by key: `local` maps rows of a batch to partial rows with the keys, `final` one key's partial rows to one."""

        def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    yield local(part)

        return KeyedFlow(self.df.mapInPandas(partial, schema).groupBy(*self.keys).applyInPandas(final, schema), self.keys)

    def fold_scan(self, aggregates: dict[str, Column], *exprs: Expr) -> KeyedFlow:  # type: ignore[override]
        """A key's aggregates beside each of its rows."""
        w = self._window()
        df = self.df.withColumns({k: v.over(w) for k, v in aggregates.items()})
        return self._as(df.select(*self.keys, *exprs) if exprs else df)

    reduce_scan = fold_scan

    def merge(self, other: Flow) -> KeyedFlow:
        return self._as(self.df.unionByName(other.df))

    def join(self, right: KeyedFlow) -> KeyedFlow:  # type: ignore[override]
        """Inner join on the keys; sides that are partitioned by them already aren't shuffled again."""
        return KeyedFlow(self.df.join(right.df.toDF(*[self.keys[right.keys.index(c)] if c in right.keys else c for c in right.df.columns]), self.keys), self.keys)

    def join_outer(self, right: KeyedFlow) -> KeyedFlow:
        return KeyedFlow(self.df.join(right.df.toDF(*[self.keys[right.keys.index(c)] if c in right.keys else c for c in right.df.columns]), self.keys, "full"), self.keys)

    def interval_join(self, right: KeyedFlow, left_ts: str, right_ts: str, lower: int, upper: int) -> Flow:  # type: ignore[override]
        return Flow(joins.interval_join(self.df, right.df, self.keys, right.keys, left_ts, right_ts, lower, upper))

    def window(self, window: Any) -> Any:
        from fluvia.operators.windows import WindowedFlow

        return WindowedFlow(self.df, self.keys, window, self.ts)

    def window_join(self, window: Any, right: KeyedFlow) -> Flow:
        from fluvia.operators.windows import window_join

        return Flow(window_join(self, right, window))

    def delta_iterate(self, rounds: int, **steps: Any) -> KeyedFlow:
        return KeyedFlow(iteration.delta_iterate(self.df, self.keys, rounds, **steps), self.keys)


class Router:
    """Sends each row to the first route whose condition it meets; rows that meet none are dropped."""

    def __init__(self, flow: Flow):
        self.flow, self.conditions = flow, []

    def add_route(self, condition: Column) -> Router:
        self.conditions.append(condition)
        return self

    def build(self) -> list[Flow]:
        chosen = F.lit(None).cast("int")
        for k in reversed(range(len(self.conditions))):
            chosen = F.when(F.coalesce(self.conditions[k], F.lit(False)), k).otherwise(chosen)
        return [self.flow.filter(chosen == k) for k in range(len(self.conditions))]


_stores: dict[Any, Any] = {}


def _memo_store(f: Callable, capacity: int) -> Any:
    """The cache of f in this Python worker: called by key, it computes from `.value` what it doesn't hold."""
    name = (getattr(f, "__module__", ""), getattr(f, "__qualname__", ""), capacity, getattr(f, "__code__", None))
    if name not in _stores:

        class Store:
            value: Any = None

            def __init__(self) -> None:
                self.get = memo(lambda key: f(self.value), capacity)

            def __call__(self, key: Any) -> Any:
                return self.get(key)

        _stores[name] = Store()
    return _stores[name]
