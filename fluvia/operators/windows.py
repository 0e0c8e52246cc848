"""Windows over keyed flows, and their aggregators."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from fluvia.operators.base import Expr, col, listed

WINDOW = "window_id"


def _spread(df: DataFrame, place: Column, size: int, slide: int) -> DataFrame:
    """df with a row for each window k (from 0) that covers [k * slide, k * slide + size) around place."""
    slide = min(slide, size)
    low = F.greatest(F.lit(0), F.ceil((place - size + 1) / slide)).cast("bigint")
    return df.withColumn(WINDOW, F.explode(F.sequence(low, F.floor(place / slide).cast("bigint"))))


@dataclass(frozen=True)
class EventTimeWindow:
    """[start, start + size) every slide, in the unit of a whole-number time column, or as durations of a timestamp column.

    align: "epoch" starts windows at multiples of slide; "first" at each key's first element, as the batch form only.
    """

    size: Any
    slide: Any = None
    align: str = "epoch"

    @classmethod
    def tumbling(cls, size: Any, align: str = "epoch") -> EventTimeWindow:
        return cls(size, size, align)

    @classmethod
    def sliding(cls, size: Any, slide: Any, align: str = "epoch") -> EventTimeWindow:
        return cls(size, slide, align)

    def assign(self, df: DataFrame, keys: list[str], ts: str, order_by: list[Expr]) -> tuple[DataFrame, list[str], Column | None]:
        if isinstance(self.size, str):
            return df.withColumn(WINDOW, F.window(ts, self.size, self.slide or self.size)), [WINDOW], None
        slide = self.slide or self.size
        if self.align == "first":
            first = df.groupBy(*keys).agg(F.min(ts).alias("__first")) if keys else df.agg(F.min(ts).alias("__first"))
            timed = df.join(first, keys) if keys else df.crossJoin(F.broadcast(first))
            return _spread(timed, F.col(ts) - F.col("__first"), self.size, slide).drop("__first"), [WINDOW], None
        low, high = F.floor((F.col(ts) - self.size) / slide) + 1, F.floor(F.col(ts) / slide)
        starts = F.transform(F.sequence(low, high), lambda k: (k * slide).cast("bigint"))
        return df.withColumn(WINDOW, F.explode(F.filter(starts, lambda s: (s <= F.col(ts)) & (F.col(ts) < s + self.size)))), [WINDOW], None


class ProcessingTimeWindow(EventTimeWindow):
    """Windows of the time at which rows arrive: the time column is one that the source stamped."""


@dataclass(frozen=True)
class CountWindow:
    """size rows of a key in order, every slide rows. exact drops what ends incomplete; otherwise the first incomplete stays."""

    size: int
    slide: int
    exact: bool = True

    @classmethod
    def tumbling(cls, size: int) -> CountWindow:
        return cls(size, size)

    @classmethod
    def sliding(cls, size: int, slide: int) -> CountWindow:
        return cls(size, slide)

    def assign(self, df: DataFrame, keys: list[str], ts: str | None, order_by: list[Expr]) -> tuple[DataFrame, list[str], Column | None]:
        if not order_by:
            raise ValueError("a count window needs order_by")
        if not keys:
            from fluvia.operators.base import dense_index

            placed = dense_index(df, order_by, "__rn")
        else:
            placed = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)) - 1)
        slide = min(self.slide, self.size)
        out = _spread(placed, F.col("__rn"), self.size, slide)
        if self.exact:
            return out.drop("__rn"), [WINDOW], F.count(F.lit(1)) == self.size
        # the first incomplete window is the first that the complete ones leave
        last = placed.groupBy(*keys).agg(F.max("__rn").alias("__last"))
        out = out.join(last, keys) if keys else out.crossJoin(F.broadcast(last))
        full = F.greatest(F.lit(0), F.floor((F.col("__last") + 1 - self.size) / slide) + 1)
        return out.where(F.col(WINDOW) <= full).drop("__rn", "__last"), [WINDOW], None


@dataclass(frozen=True)
class LastKWindow:
    """For each row the last k rows of its key, itself included."""

    k: int

    def frame(self, keys: list[str], order_by: list[Expr]) -> Any:
        return Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(-(self.k - 1), 0)


@dataclass(frozen=True)
class SessionWindow:
    """Rows of a key no further than the gap apart; exactly the gap apart stays together. Whole-number time, or a duration."""

    gap: Any

    def assign(self, df: DataFrame, keys: list[str], ts: str, order_by: list[Expr]) -> tuple[DataFrame, list[str], Column | None]:
        if isinstance(self.gap, str):
            raise ValueError("group by F.session_window for durations, as WindowedFlow.agg does")
        w = Window.partitionBy(*keys).orderBy(*(order_by or [ts]))
        new = F.coalesce(F.col(ts) - F.lag(ts).over(w) > self.gap, F.lit(True)).cast("int")
        return df.withColumn("__new", new).withColumn(WINDOW, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new"), [WINDOW], None


@dataclass(frozen=True)
class TransactionWindow:
    """Windows that rows close: `commit` and `discard` end one, the row included; what stays open at the end is dropped.

    commit_after: a time at which the window commits, if a row sets it (the latest counts; one in the row's past is the row's own
    time). Rows behind that time open the next window. Input being complete, a time that no row reaches commits too.
    """

    commit: Column
    discard: Column | None = None
    commit_after: Column | None = None

    def assign(self, df: DataFrame, keys: list[str], ts: str | None, order_by: list[Expr]) -> tuple[DataFrame, list[str], Column | None]:
        w = Window.partitionBy(*keys).orderBy(*order_by)
        yes = lambda c: F.coalesce(c, F.lit(False))
        commit, discard = yes(self.commit), yes(self.discard) if self.discard is not None else F.lit(False)
        ends = df.withColumns({"__commit": commit & ~discard, "__end": (commit | discard).cast("int")})
        ends = ends.withColumn(WINDOW, F.coalesce(F.sum("__end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if self.commit_after is not None:
            if ts is None:
                raise ValueError("commit_after needs a time column")
            own = Window.partitionBy(*keys, WINDOW).orderBy(*order_by)
            ends = ends.withColumn("__until", F.when(self.commit_after.isNotNull(), F.greatest(self.commit_after, F.col(ts))))
            so_far = F.max("__until").over(own.rowsBetween(Window.unboundedPreceding, -1))
            cut = yes((F.col(ts) > so_far) & (so_far >= F.lag(ts).over(own)))  # of a window before, the time lies before its rows
            first = F.row_number().over(own) == 1
            ends = ends.withColumns({"__commit": F.col("__commit") | F.col("__until").isNotNull(), "__opens": (cut | first).cast("int")})
            ends = ends.withColumn(WINDOW, F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__until", "__opens")
        return ends, [WINDOW], F.max("__commit")


@dataclass(frozen=True)
class AllWindow:
    """Everything of a key."""

    def assign(self, df: DataFrame, keys: list[str], ts: str | None, order_by: list[Expr]) -> tuple[DataFrame, list[str], Column | None]:
        return df, [], None


class WindowedFlow:
    """Keyed rows with a window description, waiting for an aggregator. order_by settles first, last and whole windows."""

    def __init__(self, df: DataFrame, keys: list[str], window: Any, ts: str | None = None, order_by: list[Expr] | None = None):
        self.df, self.keys, self.window, self.ts, self.order = df, keys, window, ts, listed(order_by)

    def order_by(self, *order: Expr) -> WindowedFlow:
        return WindowedFlow(self.df, self.keys, self.window, self.ts, list(order))

    def assigned(self) -> DataFrame:
        """The rows with the windows that hold them."""
        return self.window.assign(self.df, self.keys, self.ts, self.order)[0]

    def fold(self, *aggregates: Column) -> Any:
        """Any aggregates of each window."""
        from fluvia.operators.flow import KeyedFlow

        if isinstance(self.window, LastKWindow):
            raise ValueError("last-k windows give a result beside each row: use running")
        if isinstance(self.window, SessionWindow) and isinstance(self.window.gap, str):
            return KeyedFlow(self.df.groupBy(*self.keys, F.session_window(self.ts, self.window.gap).alias(WINDOW)).agg(*aggregates), self.keys)
        rows, by, keep = self.window.assign(self.df, self.keys, self.ts, self.order)
        out = rows.groupBy(*self.keys, *by).agg(*aggregates, *([keep.alias("__keep")] if keep is not None else []))
        return KeyedFlow(out.where("__keep").drop("__keep") if keep is not None else out, self.keys)

    def running(self, **aggregates: Column) -> Any:
        """Aggregates over a last-k window beside each row, by name."""
        from fluvia.operators.flow import KeyedFlow

        w = self.window.frame(self.keys, self.order or [self.ts])
        return KeyedFlow(self.df.withColumns({k: v.over(w) for k, v in aggregates.items()}), self.keys, self.ts)

    def _by(self) -> Column:
        return F.struct(*map(col, self.order or [self.ts]))

    def sum(self, value: Expr, name: str = "sum") -> Any:
        return self.fold(F.sum(value).alias(name))

    def count(self, name: str = "count") -> Any:
        return self.fold(F.count(F.lit(1)).alias(name))

    def min(self, value: Expr, name: str = "min") -> Any:
        return self.fold(F.min(value).alias(name))

    def max(self, value: Expr, name: str = "max") -> Any:
        return self.fold(F.max(value).alias(name))

    def min_by(self, element: Expr, value: Expr, name: str = "min_by") -> Any:
        """The first element, by order, of the smallest value."""
        return self.fold(F.min_by(col(element), F.struct(col(value), self._by())).alias(name))

    def max_by(self, element: Expr, value: Expr, name: str = "max_by") -> Any:
        """The first element, by order, of the largest value."""
        by = self.df.select(*map(col, self.order or [self.ts])).schema
        if all(isinstance(f.dataType, NumericType) for f in by):  # two phases, nothing is gathered
            return self.fold(F.max_by(col(element), F.struct(col(value), *(-col(o) for o in self.order or [self.ts]))).alias(name))
        best = F.struct(col(value).alias("v"), self._by().alias("o"), col(element).alias("e"))
        top = F.array_sort(F.collect_list(best), lambda a, b: F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1).when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
        return self.fold(top[0]["e"].alias(name))

    def first(self, value: Expr, name: str = "first") -> Any:
        return self.fold(F.min_by(col(value), self._by()).alias(name))

    def last(self, value: Expr, name: str = "last") -> Any:
        return self.fold(F.max_by(col(value), self._by()).alias(name))

    def to_vec(self, value: Expr, name: str = "items") -> Any:
        """The window's values in order."""
        rows = F.array_sort(F.collect_list(F.struct(self._by().alias("o"), col(value).alias("v"))))
        return self.fold(F.transform(rows, lambda r: r["v"]).alias(name))

    def map(self, f: Callable[[Column], Column], value: Expr, name: str = "result") -> Any:
        """A function of the array of a window's values in order."""
        rows = F.array_sort(F.collect_list(F.struct(self._by().alias("o"), col(value).alias("v"))))
        return self.fold(f(F.transform(rows, lambda r: r["v"])).alias(name))

    def fold_first(self, value: Expr, merge: Callable[[Column, Column], Column], name: str = "fold") -> Any:
        """A fold in order that starts with the first value."""
        return self.map(lambda xs: F.reduce(F.slice(xs, 2, F.size(xs)), xs[0], merge), value, name)

    def to_arrow(self, f: Callable[[Any], Any], schema: Any) -> Any:
        """A function of each window's rows, in order, as an Arrow table; it may take the key's values before the table.

        Rows go to Python in batches of many windows, so a short window costs little more than its call; a window's rows are gathered
        where they go on in further batches.
        """
        rows, by, keep = self.window.assign(self.df, self.keys, self.ts, self.order)
        from fluvia.operators.flow import KeyedFlow

        names = [*self.keys, *by]
        if keep is not None:  # windows that are dropped give no rows here either
            kept = rows.groupBy(*names).agg(keep.alias("__keep")).where("__keep").select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(names)))
            same = F.lit(True)
            for k, c in enumerate(names):
                same = same & F.col(c).eqNullSafe(F.col(f"__{k}"))
            rows = rows.join(kept, same, "left_semi").select(*self.df.columns, *by)
        order = self.order or ([self.ts] if self.ts else [F.lit(0)])
        opens = F.row_number().over(Window.partitionBy(*names).orderBy(*order)) == 1
        return KeyedFlow(rows.withColumn("__opens", opens).mapInArrow(_each_window(f, names, schema), schema), self.keys)


def _each_window(f: Callable[..., Any], names: list[str], schema: Any) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """f over windows whose rows follow each other; the last column of the batches marks the first row of each."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    with_key = len(inspect.getfullargspec(f).args) == 2

    def call(table: Any) -> Any:
        got = f(tuple(table.column(c)[0] for c in names), table) if with_key else f(table)
        if got.schema == target or got.num_columns == got.num_rows == 0:
            return got
        if set(got.schema.names) != set(target.names):
            raise TypeError(f"a window's result has the columns {got.schema.names}, not {target.names}")
        got = got.select(target.names)
        if got.schema.types != target.types:
            raise TypeError(f"a window's result has the types {got.schema.types}, not {target.types}")
        return got

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        made, many = [], 0

        def written() -> Iterator[Any]:
            whole = pa.concat_tables(made).combine_chunks() if made else target.empty_table()
            yield from (pa.RecordBatch.from_arrays(b.columns, schema=target) for b in whole.to_batches())
            made.clear()

        def windows() -> Iterator[Any]:
            held: list[Any] = []
            for batch in batches:
                starts = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).nonzero()[0].tolist()
                table = pa.Table.from_batches([batch.select(batch.schema.names[:-1])])
                if not starts:
                    held.append(table)
                    continue
                if starts[0]:
                    held.append(table.slice(0, starts[0]))
                if held:
                    yield pa.concat_tables(held)
                for at, end in zip(starts, starts[1:], strict=False):
                    yield table.slice(at, end - at)
                held = [table.slice(starts[-1])]
            if held:
                yield pa.concat_tables(held)

        for window in windows():
            got = call(window)
            if got.num_rows:
                made.append(got)
                many += got.num_rows
            if many >= 10_000:
                yield from written()
                many = 0
        yield from written()

    return run


def window_join(left: Any, right: Any, window: Any) -> DataFrame:
    """All pairs of both sides' rows of a key and window. Time windows are assigned on each side; count windows over both."""
    names = dict(zip(right.keys, left.keys, strict=True))
    r = right.df.withColumnsRenamed(names)
    if isinstance(window, CountWindow | TransactionWindow | SessionWindow):
        shared = [*left.keys, left.ts]
        a = left.df.select(*shared, F.lit(0).alias("__side"), F.struct("*").alias("l"), F.lit(None).cast(r.schema).alias("r"))
        b = r.select(*left.keys, F.col(right.ts).alias(left.ts), F.lit(1).alias("__side"), F.lit(None).cast(left.df.schema).alias("l"), F.struct("*").alias("r"))
        rows, by, _ = window.assign(a.unionByName(b), left.keys, left.ts, [left.ts, "__side", F.coalesce(F.to_json("l"), F.to_json("r"))])
        x, y = rows.where("__side = 0").select(*left.keys, *by, "l"), rows.where("__side = 1").select(*left.keys, *by, "r")
        return x.join(y, [*left.keys, *by])
    x, by, _ = window.assign(left.df, left.keys, left.ts, [])
    y, _, _ = window.assign(r, left.keys, right.ts, [])
    return x.join(y, [*left.keys, *by])
