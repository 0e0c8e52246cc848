"""Streaming runs of operators over the events table; each agrees with its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.operators.flow import Flow
from fluvia.operators.windows import EventTimeWindow
from fluvia.plans.catalogue import add
from fluvia.plans.tables import Tables, epoch_ms
from fluvia.streaming import stateful
from fluvia.streaming.runner import ROCKSDB, read_table, run_available


def events(t: Tables) -> DataFrame:
    """The events stream: ms and cents, and at, their time as a timestamp, which watermarks need."""
    df = read_table(t.spark, t.dir, "events")
    ms = epoch_ms("ts")
    return df.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), ms.alias("ms"), F.timestamp_millis(ms).alias("at"))


def filtered(t: Tables) -> DataFrame:
    return run_available(Flow(events(t)).filter("cents > 1000").map("event_id", "cents").df)


def windowed(t: Tables) -> DataFrame:
    flow = Flow(events(t).withWatermark("at", "1 hour"), "at").group_by("event_type")
    out = run_available(flow.window(EventTimeWindow.tumbling("1 hour")).count("n").df, "complete")
    return out.select("event_type", F.unix_millis("window_id.start").alias("w"), "n")


def sliding(t: Tables) -> DataFrame:
    flow = Flow(events(t).withWatermark("at", "1 hour"), "at").group_by("event_type")
    out = run_available(flow.window(EventTimeWindow.sliding("2 hours", "1 hour")).sum("cents", "total").df, "complete")
    return out.select("event_type", F.unix_millis("window_id.start").alias("w"), "total")


def counted(t: Tables) -> DataFrame:
    return run_available(Flow(events(t)).group_by_count("user_id", "n").df, "complete")


def unique(t: Tables) -> DataFrame:
    return run_available(events(t).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


def joined(t: Tables) -> DataFrame:
    """An interval join of two streams: the time bounds let state be dropped behind both watermarks."""
    e = events(t)
    a = e.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("click"), F.col("at").alias("clicked")).withWatermark("clicked", "1 hour")
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy"), F.col("at").alias("bought")).withWatermark("bought", "1 hour")
    near = F.expr("u = user_id AND bought BETWEEN clicked - INTERVAL 1 HOUR AND clicked + INTERVAL 2 HOURS")
    return run_available(a.join(b, near).select("click", "buy"))


def with_table(t: Tables) -> DataFrame:
    """A stream beside a table that doesn't change."""
    side = t.nation.df.select("n_nationkey", "n_name")
    return run_available(events(t).withColumn("k", (F.col("user_id") % 25).cast("int")).join(side, F.col("k") == F.col("n_nationkey")).select("event_id", "n_name"))


def _rocks(t: Tables) -> None:
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def running(t: Tables) -> DataFrame:
    _rocks(t)
    out = stateful.with_state(events(t), ["user_id"], stateful.RunningSum("cents", "event_id"), "key bigint, id bigint, total bigint")
    return run_available(out).select(F.col("id").alias("event_id"), "total")


def transactions(t: Tables) -> DataFrame:
    _rocks(t)
    step = stateful.Transactions("event_type", "cents", "event_id", "purchase", "error")
    out = stateful.with_state(events(t).select("user_id", "event_type", "cents", "event_id"), ["user_id"], step, "key bigint, total bigint, n bigint")
    return run_available(out).select(F.col("key").alias("user_id"), "total", "n")


add("stream_filter", filtered, "SELECT event_id, cents FROM timed WHERE cents > 1000")
add("stream_window_tumbling", windowed, "SELECT event_type, (ms // 3600000) * 3600000 AS w, count(*) AS n FROM timed GROUP BY event_type, ms // 3600000")
add("stream_window_sliding", sliding, "SELECT event_type, w, CAST(sum(cents) AS BIGINT) AS total FROM (SELECT event_type, cents, unnest([(ms // 3600000 - 1) * 3600000, (ms // 3600000) * 3600000]) AS w FROM timed) GROUP BY event_type, w")
add("stream_group_by_count", counted, "SELECT user_id, count(*) AS n FROM timed GROUP BY user_id")
add("stream_unique", unique, "SELECT DISTINCT user_id, event_type FROM timed")
add("stream_interval_join", joined, "SELECT a.event_id AS click, b.event_id AS buy FROM timed a JOIN timed b ON a.user_id = b.user_id AND b.ms BETWEEN a.ms - 3600000 AND a.ms + 7200000 WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
add("stream_table_join", with_table, "SELECT event_id, n_name FROM timed JOIN nation ON user_id % 25 = n_nationkey")
add("stream_rich_map", running, "SELECT event_id, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM timed")
add("stream_transactions", transactions, "SELECT user_id, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM (SELECT *, coalesce(sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM timed) GROUP BY user_id, w HAVING bool_or(event_type = 'purchase')")
