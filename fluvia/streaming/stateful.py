"""Operators with state by key that streams need and built-in ones don't give: running state, transactions, reordering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


class RunningSum(StatefulProcessor):
    """A running sum and count of a key's values, in the order of arrival within a batch by `order`."""

    def __init__(self, value: str, order: str):
        self.value, self.order = value, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "total bigint, n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        total, n = self.state.get() if self.state.exists() else (0, 0)
        got = list(rows)
        if got:
            part = pd.concat(got).sort_values(self.order)
            running = part[self.value].cumsum() + total
            out = pd.DataFrame({"key": key[0], "id": part[self.order].to_numpy(), "total": running.to_numpy()})
            self.state.update((int(running.iloc[-1]), n + len(part)))
            yield out

    def close(self) -> None:
        pass


class Transactions(StatefulProcessor):
    """Windows that a row of `commit` type closes and emits, and one of `discard` type drops; what is open waits."""

    def __init__(self, kind: str, value: str, order: str, commit: str, discard: str):
        self.kind, self.value, self.order, self.commit, self.discard = kind, value, order, commit, discard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "total bigint, n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        total, n = self.state.get() if self.state.exists() else (0, 0)
        out = []
        got = list(rows)
        if got:
            part = pd.concat(got).sort_values(self.order)
            for kind, value in zip(part[self.kind], part[self.value], strict=True):
                total, n = total + int(value), n + 1
                if kind in (self.commit, self.discard):
                    if kind == self.commit:
                        out.append((key[0], total, n))
                    total, n = 0, 0
            self.state.update((total, n))
        yield pd.DataFrame(out, columns=["key", "total", "n"]).astype({"total": "int64", "n": "int64"}) if out else pd.DataFrame()

    def close(self) -> None:
        pass


class CommitAfter(StatefulProcessor):
    """One window a key that closes at the time its opening row names: rows up to then count; it is emitted when the
    watermark passes that time."""

    def __init__(self, closes: str, ts_ms: str, value: str):
        self.closes, self.ts, self.value = closes, ts_ms, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at bigint")
        self.rows = handle.getListState("rows", "at bigint, value bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, closes, value in zip(part[self.ts], part[self.closes], part[self.value], strict=True):
                if pd.notna(closes):
                    if self.until.exists():
                        self.handle.deleteTimer(self.until.get()[0])
                    self.until.update((int(closes),))
                    self.handle.registerTimer(int(closes))
                if pd.notna(value):
                    self.rows.appendValue((int(at), int(value)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        kept = [v for at, v in self.rows.get() if at < until] if self.rows.exists() else []
        self.rows.clear()
        self.until.clear()
        if kept:
            yield pd.DataFrame({"key": [key[0]], "top": [max(kept)], "n": [len(kept)]})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


class Reorder(StatefulProcessor):
    """Holds a key's rows until the watermark passes them, then emits them in the order of their times."""

    def __init__(self, ts_ms: str, ident: str):
        self.ts, self.ident = ts_ms, ident

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at bigint, id bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, ident in zip(part[self.ts], part[self.ident], strict=True):
                self.rows.appendValue((int(at), int(ident)))
                self.handle.registerTimer(int(at))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(self.rows.get()) if self.rows.exists() else []
        ready, later = [r for r in held if r[0] <= until], [r for r in held if r[0] > until]
        self.rows.put(later) if later else self.rows.clear()
        if ready:
            yield pd.DataFrame({"key": key[0], "at": [r[0] for r in ready], "id": [r[1] for r in ready]})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def with_state(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time_mode: str = "None", mode: str = "Append") -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(schema), outputMode=mode, timeMode=time_mode)


def map_with_state(df: DataFrame, keys: list[str], f: Callable, out: str, state: str) -> DataFrame:
    """applyInPandasWithState: f(key, frames, state) with a state of any shape."""
    return df.groupBy(*keys).applyInPandasWithState(f, out, state, "append", "NoTimeout")
