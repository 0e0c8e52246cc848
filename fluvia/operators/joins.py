"""Joins: equality joins with a chosen shipping and local strategy, and interval joins."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvia.operators.base import BROADCAST_BYTES, Expr, col, estimated_bytes


class JoinBuilder:
    """left.join_with(right, k1, k2), then how rows are shipped, how they are joined, and the variant.

    Without a choice the optimizer decides. Keys are compared by SQL's equality, or with null_safe so that nulls match.
    Key expressions name columns of their own side. Columns of both sides stay; give them different names.
    """

    def __init__(self, left: DataFrame, right: DataFrame, left_key: list[Expr], right_key: list[Expr], null_safe: bool = False):
        # keys become columns first, so that an expression always means its own side
        self.lk, self.rk = [f"__lk{k}" for k in range(len(left_key))], [f"__rk{k}" for k in range(len(right_key))]
        self.a = left.withColumns({n: col(c) for n, c in zip(self.lk, left_key, strict=True)})
        self.b = right.withColumns({n: col(c) for n, c in zip(self.rk, right_key, strict=True)})
        self.null_safe, self.ship, self.local = null_safe, None, None

    def ship_hash(self) -> JoinBuilder:
        self.ship = "hash"
        return self

    def ship_broadcast_right(self) -> JoinBuilder:
        """Copies the right side to every task, if its estimated size allows it; else both sides are shuffled."""
        self.ship = "broadcast"
        return self

    def local_hash(self) -> JoinBuilder:
        self.local = "shuffle_hash"
        return self

    def local_sort_merge(self) -> JoinBuilder:
        self.local = "merge"
        return self

    def inner(self) -> DataFrame:
        return self._join("inner")

    def left(self) -> DataFrame:
        return self._join("left")

    def outer(self) -> DataFrame:
        if self.ship == "broadcast":
            raise ValueError("a broadcast side cannot be joined fully outer: its unmatched rows would appear once a task")
        return self._join("full")

    def _join(self, how: str) -> DataFrame:
        right = self.b
        if self.ship == "broadcast" and estimated_bytes(right) <= BROADCAST_BYTES:
            right = F.broadcast(right)
        elif self.local:
            right = right.hint(self.local)
        same = [F.col(a).eqNullSafe(F.col(b)) if self.null_safe else F.col(a) == F.col(b) for a, b in zip(self.lk, self.rk, strict=True)]
        return self.a.join(right, functools.reduce(operator.and_, same), how).drop(*self.lk, *self.rk)


def interval_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], left_ts: str, right_ts: str, lower: int, upper: int) -> DataFrame:
    """Pairs (of equal keys) with left - lower <= right <= left + upper.

    Times are cut into buckets as wide as the interval. A left row is sent to the two buckets at most that its interval
    touches, a right row to its own; so this is an equality join, which partitions even without keys, and each pair meets once.
    """
    width = max(1, lower + upper)
    low, high = F.floor((F.col(left_ts) - lower) / width), F.floor((F.col(left_ts) + upper) / width)
    a = left.withColumn("__bucket", F.explode(F.sequence(low, high)))
    b = right.withColumn("__bucket_r", F.floor(F.col(right_ts) / width))
    same: list[Column] = [F.col("__bucket") == F.col("__bucket_r")]
    renamed = {k: f"__r_{k}" for k in right_keys if k in left.columns}
    b = b.withColumnsRenamed(renamed)
    same += [F.col(x) == F.col(renamed.get(y, y)) for x, y in zip(left_keys, right_keys, strict=True)]
    near = F.col(right_ts).between(F.col(left_ts) - lower, F.col(left_ts) + upper)
    return a.join(b, functools.reduce(operator.and_, same) & near).drop("__bucket", "__bucket_r", *renamed.values())
