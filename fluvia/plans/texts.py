"""Text, accident and input/output workloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.functions import expressions as X
from fluvia.operators.flow import Flow
from fluvia.operators.windows import CountWindow, EventTimeWindow
from fluvia.plans.catalogue import add
from fluvia.plans.tables import Tables
from fluvia.sources import readers, writers


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: under the cluster's checkpoint folder, or a local one if none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/tmp/checkpoints"
    return f"{named}/{uuid.uuid4().hex}"


def windowed_word_count(t: Tables) -> DataFrame:
    """Occurrences of each word in windows of ten, every five."""
    words = t.documents.df.select("doc_id", F.posexplode(X.latin_words("text")).alias("pos", "word"))
    out = Flow(words).group_by("word").window(CountWindow.sliding(10, 5)).order_by("doc_id", "pos").first(F.struct("doc_id", "pos"), "f")
    return out.df.select("word", F.col("window_id").cast("bigint").alias("w"), F.col("f.doc_id").alias("doc_id"))


def top_words(counts: DataFrame, window: str, k: int) -> DataFrame:
    """The k most frequent of each window, equal ones by name: gathered k at a time by a bounded rank, not as whole windows."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(window).orderBy(F.desc("n"), "word"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def rolling_top_words(t: Tables) -> DataFrame:
    """The four most frequent event types and users of sliding windows."""
    topics = Flow(t.timed.df.select("ms", F.concat_ws("-", "event_type", F.col("user_id") % 10).alias("word")), "ms")
    counts = topics.group_by("word").window(EventTimeWindow.sliding(7_200_000, 3_600_000)).count("n").df
    return top_words(counts, "window_id", 4).select(F.col("window_id").alias("w"), "word", "n", F.col("place").cast("bigint").alias("place"))


def accidents(t: Tables) -> DataFrame:
    """Accident-like rows from orders: a date as MM/DD/YYYY, a borough, persons killed and two factors, of which one may be empty."""
    return t.orders.df.select(
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("date"), F.col("o_orderpriority").alias("borough"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") % 3 + 1).otherwise(0).cast("bigint").alias("killed"),
        F.col("o_orderstatus").alias("factor1"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.substring("o_orderpriority", 1, 1)).alias("factor2"),
    )


_ACC = "acc AS (SELECT o_orderdate, o_orderpriority AS borough, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 3 + 1 ELSE 0 END AS killed, o_orderstatus AS factor1, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE substr(o_orderpriority, 1, 1) END AS factor2, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(dayofyear(o_orderdate) // 7 AS INTEGER) AS week FROM orders)"


def accidents_by_week(rows: DataFrame) -> DataFrame:
    """Accidents with someone killed, by week."""
    return rows.where("killed > 0").withColumn("w", X.week_of("date")).groupBy("w.year", "w.week").agg(F.count(F.lit(1)).alias("n"))


def accidents_by_factor(rows: DataFrame) -> DataFrame:
    """Accidents and persons killed by contributing factor; a factor that a row names twice counts once."""
    each = rows.select("killed", F.explode(X.distinct_items("factor1", "factor2")).alias("factor"))
    return each.groupBy("factor").agg(F.count(F.lit(1)).alias("n"), F.sum("killed").alias("killed"))


def accidents_by_borough(rows: DataFrame) -> DataFrame:
    """Accidents and those with someone killed, by borough and week."""
    weeks = rows.withColumn("w", X.week_of("date"))
    return weeks.groupBy("borough", "w.year", "w.week").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("killed") > 0).cast("bigint")).alias("lethal"))


def accidents_shared(t: Tables) -> DataFrame:
    """All three from one source that is read once."""
    rows = accidents(t).persist()
    parts = [accidents_by_week(rows), accidents_by_factor(rows), accidents_by_borough(rows)]
    return parts[0].select(F.lit("week").alias("q"), "n").union(parts[1].select(F.lit("factor"), "n")).union(parts[2].select(F.lit("borough"), "n")).groupBy("q").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))


def _csv(t: Tables) -> DataFrame:
    path = shared_folder(t.spark)
    writers.write_csv(t.part.df.select("p_partkey", X.hexadecimal("p_partkey").alias("hex"), "p_name"), path)
    return readers.csv(t.spark, path, "p_partkey bigint, hex string, p_name string")


def _parquet(t: Tables) -> DataFrame:
    path = shared_folder(t.spark)
    writers.write_parquet(t.part.df.select("p_partkey", "p_retailprice", X.octal(F.col("p_partkey")).alias("oct")), path)
    return t.spark.read.parquet(path)


def _avro(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark)
    writers.write_avro(t.part.df.select("p_partkey", "p_name", "p_size", "p_retailprice"), folder)
    return readers.avro(t.spark, folder)


def _cached(t: Tables) -> DataFrame:
    held = t.timed.collect_cache("disk")
    return held.stream().group_by_count("user_id", "n").df.join(held.stream().group_by_sum("user_id", "cents", "total").df, "user_id")


def _generated(t: Tables) -> DataFrame:
    return readers.from_generator(t.spark, _every_fourth, "x bigint", 4)


def _every_fourth(index: int, peers: int):
    return ((x,) for x in range(index, 1000, peers))


async def _ten():
    for x in range(10):
        yield (x,)


def _custom(t: Tables) -> DataFrame:
    t.spark.dataSource.register(readers.GeneratorSource)
    return t.spark.read.format("fluvia_range").option("start", 5).option("end", 1005).option("partitions", 8).load()


def _channel(t: Tables) -> DataFrame:
    import queue

    q: queue.Queue = queue.Queue()
    for x in range(25):
        q.put((x, f"item {x}"))
    q.put(None)
    return readers.from_channel(t.spark, q, "x bigint, name string")


_WORDS = "words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))"
add("word_count_windowed", windowed_word_count, f"WITH {_WORDS}, r AS (SELECT word, doc_id, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) - 1 AS rn FROM words) SELECT word, w, first(doc_id ORDER BY rn) AS doc_id FROM (SELECT *, unnest(CASE WHEN rn < 5 THEN [rn // 5] ELSE [rn // 5 - 1, rn // 5] END) AS w FROM r) GROUP BY word, w HAVING count(*) = 10")
add("rolling_top_words", rolling_top_words, "SELECT w, word, n, row_number() OVER (PARTITION BY w ORDER BY n DESC, word) AS place FROM (SELECT w, word, count(*) AS n FROM (SELECT event_type || '-' || (user_id % 10) AS word, unnest([(ms // 3600000 - 1) * 3600000, (ms // 3600000) * 3600000]) AS w FROM timed) GROUP BY w, word) QUALIFY place <= 4")
add("accidents_q1", lambda t: accidents_by_week(accidents(t)), f"WITH {_ACC} SELECT year, week, count(*) AS n FROM acc WHERE killed > 0 GROUP BY year, week")
add("accidents_q2", lambda t: accidents_by_factor(accidents(t)), f"WITH {_ACC} SELECT factor, count(*) AS n, CAST(sum(killed) AS BIGINT) AS killed FROM (SELECT killed, unnest(list_distinct([factor1, factor2])) AS factor FROM acc) WHERE factor <> '' GROUP BY factor")
add("accidents_q3", lambda t: accidents_by_borough(accidents(t)), f"WITH {_ACC} SELECT borough, year, week, count(*) AS n, count(*) FILTER (killed > 0) AS lethal FROM acc GROUP BY borough, year, week")
add("accidents_shared", accidents_shared, f"WITH {_ACC}, a AS (SELECT count(*) AS n FROM acc WHERE killed > 0 GROUP BY year, week), b AS (SELECT count(*) AS n FROM (SELECT unnest(list_distinct([factor1, factor2])) AS factor FROM acc) WHERE factor <> '' GROUP BY factor), c AS (SELECT count(*) AS n FROM acc GROUP BY borough, year, week) SELECT 'week' AS q, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups FROM a UNION ALL SELECT 'factor', CAST(sum(n) AS BIGINT), count(*) FROM b UNION ALL SELECT 'borough', CAST(sum(n) AS BIGINT), count(*) FROM c")
add("csv_roundtrip", _csv, "SELECT p_partkey, lower(hex(p_partkey)) AS hex, p_name FROM part")
add("parquet_roundtrip", _parquet, "SELECT p_partkey, p_retailprice, printf('%o', p_partkey) AS oct FROM part")
add("avro_roundtrip", _avro, "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
add("cache_reuse", _cached, "SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM timed GROUP BY user_id")
add("parallel_source", _generated, "SELECT range AS x FROM range(1000)")
add("range_source", lambda t: t.spark.range(0, 1000, 1, 8), "SELECT range AS id FROM range(1000)")
add("async_source", lambda t: readers.from_async(t.spark, _ten, "x bigint"), "SELECT range AS x FROM range(10)")
add("custom_source", _custom, "SELECT range AS value FROM range(5, 1005)")
add("channel_source", _channel, "SELECT range AS x, 'item ' || range AS name FROM range(25)")
add("iter_source", lambda t: readers.from_rows(t.spark, [(x, x * x) for x in range(50)], "x bigint, y bigint"), "SELECT range AS x, range * range AS y FROM range(50)")
