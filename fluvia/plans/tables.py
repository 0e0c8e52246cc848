"""The driver's tables as flows."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fluvia.operators.flow import Flow


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.datediff(ts, F.lit("1970-01-01")).cast("bigint") * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")


class Tables:
    """Tables of a folder by name; columns that a query doesn't use are never read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> Flow:
        return Flow(self.spark.read.parquet(f"{self.dir}/{name}.parquet"))

    @property
    def timed(self) -> Flow:
        """Events with their time in milliseconds and their value in whole cents."""
        df = self.events.df.withColumns({"ms": epoch_ms("ts"), "cents": F.round(F.col("value") * 100).cast("bigint")})
        return Flow(df.select("event_id", "ms", "user_id", "event_type", "cents"), "ms")

    @property
    def edges(self) -> Flow:
        """An undirected graph between suppliers and parts."""
        e = self.lineitem.df.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000).alias("b")).distinct()
        return Flow(e)


#: The same in SQL.
TIMED = "timed AS (SELECT event_id, (epoch_us(ts) // 1000) AS ms, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
EDGES = "edges AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem)"
