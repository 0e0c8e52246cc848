"""Sources, sinks, caches and configuration."""

import asyncio
import queue

import pytest
from pyspark.sql import functions as F

from fluvia.config import ConfigBuilder, RuntimeConfig
from fluvia.functions import expressions as X
from fluvia.operators.flow import Flow
from fluvia.session import FlowContext
from fluvia.sources import readers


@pytest.fixture
def ctx(spark):
    return FlowContext(spark)


def test_sources(ctx):
    assert ctx.stream_iter([(1, "a"), (2, "b")], "x int, s string").collect_count() == 2
    assert ctx.stream_range(3, 9, 4).collect_count() == 6
    assert sorted(r[0] for r in ctx.stream_par_iter(lambda i, n: ((x,) for x in range(i, 20, n)), "x int", 3).collect_vec()) == list(range(20))

    async def numbers():
        for x in range(4):
            await asyncio.sleep(0)
            yield (x,)

    assert [r[0] for r in ctx.stream_async(numbers, "x int").collect_vec()] == [0, 1, 2, 3]


def test_channels(ctx):
    q = queue.Queue()
    for x in [(1,), (2,), None]:
        q.put(x)
    flow = ctx.stream_channel(q, "x int")
    flow.collect_channel(q)
    assert sorted([q.get()["x"], q.get()["x"]]) == [1, 2] and q.get() is None


def test_files(ctx, tmp_path):
    (tmp_path / "t.txt").write_text("a b\nc\n")
    assert ctx.stream_file(str(tmp_path / "t.txt")).flat_map(F.split("value", " "), "w").collect_count() == 3


@pytest.mark.parametrize("one", [True, False])
def test_csv(ctx, tmp_path, one):
    rows = [(x, f'say "{x}", twice\\') for x in range(100)]
    ctx.stream_iter(rows, "x int, s string").shuffle(3).write_csv(str(tmp_path / "c"), one=one)
    assert sorted(map(tuple, ctx.stream_csv(str(tmp_path / "c"), "x int, s string").collect_vec())) == sorted(rows)
    assert len(list((tmp_path / "c").glob("part-*"))) == (1 if one else 3)


def test_csv_options(ctx, tmp_path):
    (tmp_path / "o.csv").write_text("# note\n1; 'a;b' \n2;c\n")
    got = ctx.stream_csv(str(tmp_path / "o.csv"), "x int, s string", has_headers=False, delimiter=";", quote="'", comment="#", trim=True).collect_vec()
    assert sorted(map(tuple, got)) == [(1, "a;b"), (2, "c")]
    (tmp_path / "bad.csv").write_text("x\nnone\n")
    with pytest.raises(Exception):  # noqa: B017  a malformed row fails the query
        ctx.stream_csv(str(tmp_path / "bad.csv"), "x int").collect_vec()


def test_parquet_and_caches(ctx, tmp_path):
    flow = ctx.stream_range(0, 100)
    flow.write_parquet(str(tmp_path / "p"))
    assert ctx.stream_parquet(str(tmp_path / "p")).collect_count() == 100
    for level, path in (("memory", None), ("disk", None), ("parquet", str(tmp_path / "cache"))):
        held = flow.collect_cache(level, path)
        assert held.stream().collect_count() == 100
        held.drop()
    with pytest.raises(ValueError):
        flow.cache("parquet")


def test_missing_packages(ctx):
    with pytest.raises(RuntimeError, match="kafka"):
        ctx.stream_kafka("localhost:1", ["t"])


def test_avro(ctx, spark, tmp_path):
    rows = [(k, f"ü{k}", k / 7, k % 2 == 0, bytes([k]), [k, None], {"a": k}, None if k % 3 else k, (k, "in")) for k in range(-100, 100) if k >= 0]
    schema = "i int, s string, d double, b boolean, raw binary, xs array<bigint>, m map<string,int>, n bigint, r struct<a: int, b: string>"
    ctx.stream_iter(rows, schema).shuffle(3).write_avro(str(tmp_path / "a"))
    back = ctx.stream_avro(str(tmp_path / "a"))
    assert back.df.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    key = lambda r: r["i"]
    assert sorted(back.collect_vec(), key=key) == sorted(spark.createDataFrame(rows, schema).collect(), key=key)
    ctx.stream_iter(rows, schema).write_avro(str(tmp_path / "one"), one=True)
    assert len(list((tmp_path / "one").glob("*.avro"))) == 1


def test_avro_foreign_schema():
    import io

    from fluvia.sources import avro_files as A

    schema = {"type": "record", "name": "r", "fields": [{"name": "e", "type": {"type": "enum", "name": "k", "symbols": ["x", "y"]}}, {"name": "f", "type": {"type": "fixed", "name": "two", "size": 2}}, {"name": "again", "type": ["null", "k"]}]}
    assert A.decode(io.BytesIO(b"\x02ab\x02\x00"), schema, {}) == {"e": "y", "f": b"ab", "again": "x"}
    for n in (0, -1, 1, 63, 64, -64, -65, 2**62, -(2**63)):
        out = bytearray()
        A.write_long(out, n)
        assert A.read_long(io.BytesIO(bytes(out))) == n


def test_pluggable_writer(ctx, tmp_path):
    from fluvia.sources.writers import Writer

    folder = str(tmp_path)

    def make():
        class Lines(Writer):
            def setup(self, partition):
                self.file = open(f"{folder}/{partition}", "w")  # noqa: SIM115

            def write(self, row):
                self.file.write(f"{row['id']}\n")

            def finalize(self):
                self.file.close()

        return Lines()

    ctx.stream_range(0, 50, 4).write_with(make, 7)
    assert sorted(int(x) for p in tmp_path.iterdir() for x in p.read_text().split()) == list(range(50))


def test_custom_source(spark):
    spark.dataSource.register(readers.GeneratorSource)
    assert spark.read.format("fluvia_range").option("end", 11).load().count() == 11


def test_side_effects(ctx, spark):
    seen = spark.sparkContext.accumulator(0)
    ctx.stream_range(0, 10).for_each(lambda r: seen.add(r["id"]))
    assert seen.value == 45
    assert ctx.stream_range(0, 3).collect(lambda rows: {r["id"] for r in rows}) == {0, 1, 2}
    assert len(ctx.stream_range(0, 3).collect_all().value) == 3


def test_config():
    c, rest = RuntimeConfig.from_args(["-l", "3", "input"])
    assert (c.parallelism, c.spark_settings()["spark.master"], rest) == (3, "local[3]", ["input"])
    text = 'master = "spark://m:7077"\n[[host]]\naddress = "a"\nnum_cores = 4\n[[host]]\naddress = "b"\nnum_cores = 2\n[spark]\n"spark.executor.memory" = "2g"\n'
    c = ConfigBuilder.new_remote().parse_toml_str(text).setting("spark.x", "1").build()
    assert c.parallelism == 6 and c.spark_settings()["spark.executor.memory"] == "2g" and c.spark_settings()["spark.master"] == "spark://m:7077"
    with pytest.raises(ValueError):
        ConfigBuilder.new_remote().build()


def test_expressions(spark):
    df = spark.createDataFrame([("03/01/2020", "b", "", "b", [1, 2, 3], 10)], "d string, p string, q string, r string, xs array<int>, n bigint")
    row = df.select(X.week_of("d").alias("w"), X.distinct_items("p", "q", "r").alias("f"), X.pairs("xs").alias("pairs"), X.dollars_to_euros("n").alias("e"), X.octal(F.col("n")).alias("o"), X.hexadecimal("n").alias("h"), X.words(F.lit(" A  b ")).alias("words")).first()
    assert (row["w"]["year"], row["w"]["week"], row["f"], [tuple(p) for p in row["pairs"]], row["e"], row["o"], row["h"], row["words"]) == (2020, 61 // 7, ["b"], [(1, 2), (1, 3), (2, 3)], 9, "12", "a", ["a", "b"])


def test_collatz(spark):
    got = dict(map(tuple, spark.range(1, 8).select("id", X.collatz_steps("id")).collect()))
    assert got == {1: 0, 2: 1, 3: 7, 4: 2, 5: 5, 6: 8, 7: 16}


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan; broadcasts happen below the size limit alone."""
    Flow(spark.range(1000).selectExpr("id", "id % 10 AS k", "cast(id AS string) AS s")).write_parquet(str(tmp_path / "p"))
    flow = FlowContext(spark).stream_parquet(str(tmp_path / "p"))
    plan = flow.filter("k = 3").map("id").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan
    big = Flow(spark.range(1 << 40).toDF("b"))
    joined = big.map(id="b").join_with(big, "id", "b").ship_broadcast_right().inner()
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
