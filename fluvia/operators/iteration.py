"""Loops: the driver holds a small state, the rows stay distributed."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame

from fluvia.operators.checkpoints import cut


def iterate(df: DataFrame, rounds: int, state: Any, body: Callable[[DataFrame, Any], DataFrame], local_fold: Callable[[DataFrame], DataFrame], global_fold: Callable[[Any, Any], Any], condition: Callable[[Any], bool] | None = None) -> tuple[Any, DataFrame]:
    """(state, rows) of a loop that feeds body's rows back.

    In each round body(rows, state) gives new rows, local_fold(rows) a one-row aggregate, global_fold(state, row) the new
    state. The loop ends after `rounds` or when condition(state) is false; one round always runs. Rows are written to the
    checkpoint folder in each round, so plans don't grow and lost executors cost no earlier round.
    """
    for _ in range(max(1, rounds)):
        df = cut(body(df, state))
        row = local_fold(df).first()
        if row is not None:
            state = global_fold(state, row)
        if condition is not None and not condition(state):
            break
    return state, df


def replay(df: DataFrame, rounds: int, state: Any, body: Callable[[DataFrame, Any], DataFrame], local_fold: Callable[[DataFrame], DataFrame], global_fold: Callable[[Any, Any], Any], condition: Callable[[Any], bool] | None = None) -> Any:
    """As iterate, but every round starts from the same rows; only the state is kept."""
    df = df.persist()
    try:
        for _ in range(max(1, rounds)):
            row = local_fold(body(df, state)).first()
            if row is not None:
                state = global_fold(state, row)
            if condition is not None and not condition(state):
                break
    finally:
        df.unpersist()
    return state


def delta_iterate(state: DataFrame, keys: list[str], rounds: int, *, body: Callable[[DataFrame], DataFrame], process: dict[str, Column], output: list[Column], changed: Column | None = None) -> DataFrame:
    """A state by key, changed by deltas.

    body(state) gives rows of the keys and delta columns, one a key at most; `process` new values of state columns from those
    and the deltas (null where a key has none). The loop ends after `rounds`, or when `changed`, over old (old_*), new and
    delta columns, holds for no row. `output` is selected from the last state, for all keys.
    """
    cols = state.columns
    for _ in range(rounds):
        deltas = body(state)
        old = state.withColumnsRenamed({c: f"old_{c}" for c in process})
        joined = old.join(deltas, keys, "left").withColumns(process)
        moved = cut(joined)
        state = moved.select(*cols)
        if changed is not None and moved.where(changed).isEmpty():
            break
    return state.select(*keys, *output)
