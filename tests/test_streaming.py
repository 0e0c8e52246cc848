"""Streams over several files agree with batches; late rows, state and timers."""

import pytest
from pyspark.sql import functions as F

from fluvia.operators.flow import Flow
from fluvia.operators.windows import EventTimeWindow
from fluvia.streaming import stateful
from fluvia.streaming.runner import ROCKSDB, run_available


@pytest.fixture
def stream(spark, tmp_path):
    """Rows (id, k, at in seconds, x) as files that arrive one by one."""

    def make(*files):
        for n, rows in enumerate(files):
            df = spark.createDataFrame(rows, "id bigint, k bigint, s bigint, x bigint").withColumn("at", F.timestamp_seconds("s"))
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f={n}"))
        schema = "id bigint, k bigint, s bigint, x bigint, at timestamp"
        # one batch for each folder, in their order
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "f=*"))

    return make


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_window_counts_and_late_rows(stream):
    s = stream([(1, 0, 10, 1), (2, 0, 70, 1)], [(3, 0, 500, 1)], [(6, 0, 600, 1)], [(4, 0, 20, 1), (5, 0, 9999, 1)])
    out = run_available(Flow(s.withWatermark("at", "60 seconds"), "at").group_by("k").window(EventTimeWindow.tumbling("1 minute")).count("n").df)
    got = rows(out.select(F.unix_seconds("window_id.start"), "n"))
    # the row of second 20 came when the watermark had passed its window
    assert [g for g in got if g[0] < 9000] == [(0, 1), (60, 1), (480, 1), (600, 1)]


def test_dedup_within_stream(stream):
    s = stream([(1, 0, 1, 5), (1, 0, 1, 5)], [(1, 0, 1, 5), (2, 0, 2, 5)])
    assert rows(run_available(s.select("id").dropDuplicates(["id"]))) == [(1,), (2,)]


def test_running_state_over_batches(spark, stream):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    s = stream([(1, 0, 1, 5), (2, 1, 1, 7)], [(3, 0, 2, 10), (4, 1, 2, 1)])
    out = run_available(stateful.with_state(s, ["k"], stateful.RunningSum("x", "id"), "key bigint, id bigint, total bigint"))
    assert rows(out.select("id", "total")) == [(1, 5), (2, 7), (3, 15), (4, 8)]


def test_commit_after_watermark(spark, stream):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # rows of second 5 open a window that closes at second 100; x is the bid, and id 0 marks the opening row
    s = stream([(0, 1, 5, 0), (1, 1, 50, 30), (2, 1, 90, 40)], [(3, 1, 150, 99), (4, 2, 9999, 1)]).withWatermark("at", "1 second")
    timed = s.select("k", F.unix_millis("at").alias("ms"), F.when(F.col("id") == 0, F.lit(100_000)).cast("bigint").alias("closes"), F.when(F.col("id") > 0, F.col("x")).alias("bid"), "at")
    out = run_available(stateful.with_state(timed, ["k"], stateful.CommitAfter("closes", "ms", "bid"), "key bigint, top bigint, n bigint", "EventTime"))
    assert rows(out) == [(1, 40, 2)]


def test_reorder(spark, stream):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    s = stream([(1, 0, 1, 0), (3, 0, 3, 0), (2, 0, 2, 0)], [(6, 0, 6, 0), (4, 0, 4, 0), (5, 0, 5, 0), (9, 1, 9999, 0)]).withWatermark("at", "10 seconds")
    timed = s.select("k", "id", F.unix_millis("at").alias("ms"), "at")
    out = run_available(stateful.with_state(timed, ["k"], stateful.Reorder("ms", "id"), "key bigint, at bigint, id bigint", "EventTime"))
    assert [r for r in rows(out) if r[0] == 0] == [(0, k * 1000, k) for k in range(1, 7)]
