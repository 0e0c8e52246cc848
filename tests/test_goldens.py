"""Small inputs with known results."""

import itertools

import pytest
from pyspark.sql import functions as F

from fluvia.operators.flow import Flow
from fluvia.operators.windows import AllWindow, CountWindow, EventTimeWindow, LastKWindow, SessionWindow, TransactionWindow, window_join


@pytest.fixture
def ints(spark):
    return lambda *xs: Flow(spark.createDataFrame([(x,) for x in xs], "x bigint"))


@pytest.fixture
def keyed(spark):
    return lambda *xs, by=2: Flow(spark.createDataFrame([(x % by, x) for x in xs], "k bigint, x bigint"), "x").group_by("k")


def values(flow, *names):
    rows = (flow.df if isinstance(flow, Flow) else flow).select(*(names or ["x"])).collect()
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in rows)


def lists(flow, name="items"):
    return sorted(list(r[0]) for r in flow.df.select(name).collect())


def test_stateless(ints, spark):
    f = ints(*range(10))
    assert values(f.filter("x % 2 = 0")) == [0, 2, 4, 6, 8]
    assert values(f.map(x=F.col("x") * 10)) == list(range(0, 100, 10))
    assert values(f.filter_map(F.when(F.col("x") % 2 == 0, F.col("x") * 3), "x")) == [0, 6, 12, 18, 24]
    nested = Flow(spark.createDataFrame([([1, 2, 3],), ([],), ([4, 5],), (None,)], "x array<int>"))
    assert values(nested.flatten("x")) == [1, 2, 3, 4, 5]


def test_rich_map(ints, keyed):
    assert values(ints(*range(1, 6)).rich_map("x", total=F.sum("x")), "total") == [1, 3, 6, 10, 15]
    assert values(ints(*range(1, 6)).enumerate("x"), "index", "x") == [(k, k + 1) for k in range(5)]
    assert values(keyed(*range(10)).rich_map("x", n=F.count(F.lit(1))), "k", "n") == [(k, n) for k in (0, 1) for n in range(1, 6)]


def test_rich_filter_map(spark):
    f = Flow(spark.createDataFrame(list(enumerate([1, 2, -5, 3, 1])), "i int, x int"))
    assert [r["s"] for r in f.rich_filter_map("i", F.col("s") > 0, s=F.sum("x")).df.orderBy("i").collect()] == [1, 3, 1, 2]


def test_folds(ints, keyed):
    f = ints(*range(5))
    assert values(f.fold(F.sum("x").alias("x"))) == values(f.reduce(F.sum("x").alias("x"))) == [10]
    assert values(f.filter("x > 9").fold(F.sum("x").alias("x"))) == []
    assert f.filter("x > 9").collect_count() == 0
    assert values(keyed(*range(10)).fold_ordered(F.col("x").cast("string"), "x", F.lit(""), lambda a, x: F.concat(a, x), "s"), "k", "s") == [(0, "02468"), (1, "13579")]
    assert values(ints(*range(10)).group_by_avg((F.col("x") % 2).alias("k"), "x"), "k", "avg") == [(0, 4.0), (1, 5.0)]


def test_scans(ints, keyed):
    assert values(ints(*range(200, 210)).reduce_scan([F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")], "x", "s", "n"), "x", "s", "n") == [(x, 2045, 10) for x in range(200, 210)]
    got = values(keyed(*range(100), by=5).reduce_scan({"s": F.sum("x")}, "x", "s"), "k", "x", "s")
    assert got == sorted((x % 5, x, sum(range(x % 5, 100, 5))) for x in range(100))


def test_places(ints):
    f = ints(*range(100))
    assert values(f.broadcast(4).fold(F.sum("x").alias("x"))) == [4950 * 4]
    assert values(ints(*range(80)).limit(20, 40, "x")) == list(range(40, 60))
    a, b = ints(*range(10)).route().add_route(F.col("x") < 5).add_route(F.col("x") % 2 == 0).build()
    assert (values(a), values(b)) == ([0, 1, 2, 3, 4], [6, 8])
    assert values(ints(*range(10)).merge(ints(*range(10, 20)))) == list(range(20))
    assert values(ints(1, 1, 2).unique_assoc()) == [1, 2]
    assert values(ints(3, 4, 5).replication(1)) == [3, 4, 5]


def test_key_by_partition(ints):
    got = ints(*range(10)).repartition_by(3, "x").key_by(k=F.col("x") % 2, per_partition=True)
    assert got.keys == ["partition", "k"]
    assert values(got.fold(F.count(F.lit(1)).alias("n")).drop_key().fold(F.sum("n").alias("x"))) == [10]


def test_zip(spark):
    a, b = Flow(spark.createDataFrame([(c,) for c in "ABCD"], "a string")), Flow(spark.createDataFrame([(x,) for x in (1, 2, 3)], "b int"))
    assert values(a.zip(b, "a", "b"), "a", "b") == [("A", 1), ("B", 2), ("C", 3)]
    assert values(a.filter("a > 'Z'").zip(b, "a", "b"), "a", "b") == []


def test_memo(ints):
    got = values(ints(*range(5, 15)).map_memo_by(lambda x: x * x % 7, "x", F.col("x") % 7, "y", "bigint", 7), "x", "y")
    assert [y for _, y in got] == [4, 1, 0, 1, 4, 2, 2, 4, 1, 0]


@pytest.mark.parametrize("n1, n2, m", [(5, 10, 7), (200, 200, 7), (10, 5, 3)])
@pytest.mark.parametrize("ship", ["ship_hash", "ship_broadcast_right"])
@pytest.mark.parametrize("local", ["local_hash", "local_sort_merge"])
def test_join_matrix(spark, n1, n2, m, ship, local):
    a, b = Flow(spark.range(n1).toDF("a")), Flow(spark.range(n2).toDF("b"))
    make = lambda: getattr(getattr(a.join_with(b, F.col("a") % m, F.col("b") % m), ship)(), local)()
    pairs = [(x, y) for x, y in itertools.product(range(n1), range(n2)) if x % m == y % m]
    assert values(make().inner(), "a", "b") == sorted(pairs)
    left = pairs + [(x, None) for x in range(n1) if not any(x % m == y % m for y in range(n2))]
    by_none = lambda rows: sorted(rows, key=str)
    assert by_none(tuple(r) for r in make().left().select("a", "b").collect()) == by_none(left)
    if ship == "ship_hash":
        full = left + [(None, y) for y in range(n2) if not any(x % m == y % m for x in range(n1))]
        assert by_none(tuple(r) for r in make().outer().select("a", "b").collect()) == by_none(full)
    else:
        with pytest.raises(ValueError):
            make().outer()


def test_join_nulls(spark):
    a, b = Flow(spark.createDataFrame([(1,), (None,)], "a int")), Flow(spark.createDataFrame([(1,), (None,)], "b int"))
    assert a.join(b, "a", "b").collect_count() == 1
    assert a.join_with(b, "a", "b", null_safe=True).inner().count() == 2


@pytest.mark.parametrize("with_key", [True, False])
def test_interval_join(spark, with_key):
    a, b = (Flow(spark.createDataFrame([(x % 2, x) for x in range(10)], f"k int, {n} bigint")) for n in "lr")
    got = a.group_by("k").interval_join(b.group_by("k"), "l", "r", 1, 2) if with_key else a.map("l").interval_join(b.map("r"), "l", "r", 1, 2)
    want = [(x, y) for x in range(10) for y in range(10) if x - 1 <= y <= x + 2 and (not with_key or x % 2 == y % 2)]
    assert values(got, "l", "r") == sorted(want)


def test_count_windows(ints, keyed):
    assert values(ints(*range(10)).window_all(CountWindow.sliding(3, 2)).order_by("x").first("x"), "first") == [0, 2, 4, 6]
    w = keyed(*range(10)).window(CountWindow.sliding(3, 2)).order_by("x")
    assert values(w.first("x"), "k", "first") == [(0, 0), (0, 4), (1, 1), (1, 5)]
    assert values(w.sum("x"), "k", "sum") == [(0, 6), (0, 18), (1, 9), (1, 21)]
    assert lists(ints(*range(1, 6)).window_all(CountWindow.sliding(4, 1)).order_by("x").to_vec("x")) == [[1, 2, 3, 4], [2, 3, 4, 5]]
    assert lists(ints(*range(1, 6)).window_all(CountWindow(4, 1, exact=False)).order_by("x").to_vec("x")) == [[1, 2, 3, 4], [2, 3, 4, 5], [3, 4, 5]]
    with pytest.raises(ValueError):
        keyed(1).window(CountWindow.tumbling(2)).count()


def test_last_k(ints):
    got = ints(*range(6)).group_by(k=F.lit(0)).window(LastKWindow(3)).order_by("x").running(items=F.collect_list("x"))
    assert lists(got) == [[0], [0, 1], [0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 5]]


def test_event_windows(spark, keyed):
    dense = Flow(spark.createDataFrame([(x, x // 10) for x in range(1, 100)], "x bigint, t bigint"), "t")
    assert lists(dense.window_all(EventTimeWindow.sliding(5, 4, "first")).order_by("x").to_vec("x")) == [list(range(1, 50)), list(range(40, 90)), list(range(80, 100))]
    sparse = Flow(spark.createDataFrame([(x, x) for x in (1, 15, 16, 30, 31)], "x bigint, t bigint"), "t")
    assert [1] in lists(sparse.window_all(EventTimeWindow.tumbling(5, "first")).order_by("x").to_vec("x"))
    assert values(keyed(*range(10)).window(EventTimeWindow.tumbling(3)).order_by("x").first("x"), "first") == [0, 1, 3, 4, 6, 7, 9]
    got = values(keyed(*range(0, 10_000, 1000), by=2000).window(EventTimeWindow.sliding(3000, 2500)).order_by("x").first("x"), "window_id", "first")
    assert [v for w, v in got if w >= 0] == [0, 1000, 3000, 4000, 5000, 6000, 8000, 9000]


def test_windows_by_timestamp_agree(spark):
    df = spark.createDataFrame([(k % 2, k * 700) for k in range(40)], "k int, ms bigint").withColumn("t", F.timestamp_millis("ms"))
    a = Flow(df, "ms").group_by("k").window(EventTimeWindow.sliding(3000, 1000)).count("n").df.select("k", "window_id", "n")
    b = Flow(df, "t").group_by("k").window(EventTimeWindow.sliding("3 seconds", "1 second")).count("n").df.select("k", F.unix_millis("window_id.start"), "n")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_session(spark):
    rows = [(x, x * 10 + (100 if x >= 33 else 0) + (100 if x >= 80 else 0)) for x in range(100)]
    got = Flow(spark.createDataFrame(rows, "x bigint, t bigint"), "t").group_by(k=F.lit(0)).window(SessionWindow(50)).order_by("t").to_vec("x")
    assert lists(got) == [list(range(33)), list(range(33, 80)), list(range(80, 100))]


def test_transactions(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "commit", 2), (3, "b", 4), (4, "discard", 8), (5, "c", 16), (6, "commit", 32), (7, "open", 64)], "t int, kind string, x bigint")
    w = TransactionWindow(F.col("kind") == "commit", F.col("kind") == "discard")
    assert values(Flow(df, "t").group_by(k=F.lit(0)).window(w).order_by("t").sum("x"), "sum") == [3, 48]


def test_window_aggregators(keyed):
    w = keyed(*range(10)).window(AllWindow()).order_by("x")
    assert values(w.min("x"), "min") == [0, 1]
    assert values(w.max_by("x", F.col("x") % 4), "max_by") == [2, 3]
    assert values(w.min_by("x", F.col("x") % 4), "min_by") == [0, 1]
    assert values(w.last("x"), "last") == [8, 9]
    assert values(w.fold_first("x", lambda a, x: a * 2 + x), "fold") == [((((0 * 2 + 2) * 2 + 4) * 2 + 6) * 2 + 8), ((((1 * 2 + 3) * 2 + 5) * 2 + 7) * 2 + 9)]


def test_window_join(spark):
    a = Flow(spark.createDataFrame([(x % 2, x) for x in range(10)], "k int, a bigint"), "a").group_by("k")
    b = Flow(spark.createDataFrame([(x % 2, x) for x in range(10)], "k int, b bigint"), "b").group_by("k")
    got = values(window_join(a, b, EventTimeWindow.tumbling(3)), "a", "b")
    assert got == sorted((x, y) for x in range(10) for y in range(10) if x % 2 == y % 2 and x // 3 == y // 3)


def test_window_join_by_count(spark):
    a = Flow(spark.createDataFrame([(0, x) for x in (0, 2, 4, 6)], "k int, a bigint"), "a").group_by("k")
    b = Flow(spark.createDataFrame([(0, x) for x in (1, 3, 5, 7)], "k int, b bigint"), "b").group_by("k")
    got = window_join(a, b, CountWindow.tumbling(4)).select("l.a", "r.b").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (0, 3), (2, 1), (2, 3), (4, 5), (4, 7), (6, 5), (6, 7)]


def test_iterate(ints):
    state, out = ints(*range(3)).iterate(3, 0, lambda df, s: df.select((F.col("x") + 10).alias("x")), lambda df: df.agg(F.sum("x").alias("s")), lambda s, r: s + r["s"])
    assert (state, values(out)) == (33 + 63 + 93, [30, 31, 32])


def test_replay_stops(ints):
    seen = []
    state = ints(*range(5)).replay(9, 4, lambda df, s: df, lambda df: df.agg(F.sum("x").alias("s")), lambda s, r: seen.append(r["s"]) or s - 1, lambda s: s > 1)
    assert (state, seen) == (1, [10, 10, 10])


def test_delta_iterate_keeps_all_keys(spark):
    start = spark.createDataFrame([(0, 0), (1, 5), (2, 9)], "k int, v bigint")
    got = Flow(start).group_by("k").delta_iterate(4, body=lambda s: s.where("v < 7").select("k", F.lit(1).alias("d")), process={"v": F.col("old_v") + F.coalesce("d", F.lit(0))}, output=[F.col("v")], changed=F.col("d").isNotNull())
    assert values(got, "k", "v") == [(0, 4), (1, 7), (2, 9)]


def test_merge_distinct(spark):
    a, b = Flow(spark.createDataFrame([(1, "x")], "i int, s string")), Flow(spark.createDataFrame([(2.5,)], "d double"))
    rows = sorted(a.merge_distinct(b).df.collect(), key=lambda r: r["side"])
    assert rows[0]["left"]["s"] == "x" and rows[0]["right"] is None and rows[1]["right"]["d"] == 2.5


def test_fold_pandas(ints):
    import pandas as pd

    f = ints(*range(100)).repartition_by(5, "x").fold_pandas(lambda p: pd.DataFrame({"top": [p["x"].max()]}), lambda p: pd.DataFrame({"top": [p["top"].max()]}), "top bigint")
    assert values(f, "top") == [99]


def test_commit_after_closes_at_its_time(spark):
    """Rows behind the closing time open the next window, which needs a commit of its own."""
    rows = [(1, 1, 10, 3), (1, 2, 20, None), (1, 9, 40, None), (2, 1, 1, 5), (2, 4, 2, 8), (2, 8, 4, None), (2, 9, 8, 9), (2, 10, 16, None)]
    flow = Flow(spark.createDataFrame(rows, "k bigint, at bigint, x bigint, until bigint"), "at").group_by("k")
    w = flow.window(TransactionWindow(F.lit(False), commit_after=F.col("until"))).order_by("at").sum("x", "total")
    assert sorted(map(tuple, w.df.select("k", "window_id", "total").collect())) == [(1, 0, 30), (2, 0, 7), (2, 1, 8)]


def test_to_arrow_leaves_dropped_windows_out(spark):
    flow = Flow(spark.createDataFrame([(1, k) for k in range(5)], "k bigint, x bigint"), "x").group_by("k")
    got = flow.window(CountWindow.tumbling(3)).order_by("x").to_arrow(lambda t: t.select(["k", "x"]), "k bigint, x bigint")
    assert sorted(r["x"] for r in got.df.collect()) == [0, 1, 2]


def test_to_arrow_hands_windows_over_whole(spark):
    """Windows longer than a batch, many short ones, null and NaN keys, rows in order, results of any length, the key before the table."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = [(1.0, 25_000 - k) for k in range(25_000)] + [(None, 7), (float("nan"), 5), (None, 3), (float("nan"), 2), (0.0, 1), (-0.0, 2)] + [(float(k), k) for k in range(2, 9_000)]
    flow = Flow(spark.createDataFrame(rows, "k double, x bigint").repartition(3), "x").group_by("k")
    w = flow.window(AllWindow()).order_by("x")
    some = lambda t: pa.table({"n": pa.array([t.num_rows]), "k": t["k"].slice(0, 1), "first": t["x"].slice(0, 1), "sorted": [t["x"].to_pylist() == sorted(t["x"].to_pylist())]})
    got = [tuple(r) for r in w.to_arrow(some, "k double, n bigint, first bigint, sorted boolean").df.collect()]
    assert len(got) == 4 + 8_998 and all(r[3] for r in got) and sum(r[1] for r in got) == len(rows)
    assert sorted((str(k), n, first) for k, n, first, _ in got if n > 1) == [("0.0", 2, 1), ("1.0", 25_000, 1), ("None", 2, 3), ("nan", 2, 2)]
    twice = lambda key, t: pa.table({"k": pa.array([key[0].as_py()] * 2, pa.float64()), "x": [pc.max(t["x"]).as_py()] * 2}) if t.num_rows == 2 else pa.table({})
    assert sorted(r["x"] for r in w.to_arrow(twice, "k double, x bigint").df.collect()) == [2, 2, 5, 5, 7, 7]
    with pytest.raises(Exception, match="types"):
        w.to_arrow(lambda t: pa.table({"n": pa.array([1], pa.int32())}), "n bigint").df.collect()
    with pytest.raises(Exception, match="columns"):
        w.to_arrow(lambda t: pa.table({"m": [1]}), "n bigint").df.collect()
    none = Flow(spark.createDataFrame([], "k bigint, x bigint"), "x").group_by("k").window(AllWindow()).to_arrow(lambda t: t, "k bigint, x bigint")
    assert none.df.collect() == []


def test_to_arrow_passes_many_windows_at_a_time(spark):
    """Python is given batches of windows; a group of Spark's own for each costs a millisecond and more a window."""
    flow = Flow(spark.range(10).selectExpr("id AS k", "id AS x"), "x").group_by("k").window(EventTimeWindow.tumbling(5)).order_by("x")
    plan = flow.to_arrow(lambda t: t.select(["k", "x"]), "k bigint, x bigint").df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_refusals(ints):
    with pytest.raises(ValueError):
        ints(1).batch_mode("no such mode")
    with pytest.raises(ValueError):
        ints(1, 2, 3).collect_all(2)
