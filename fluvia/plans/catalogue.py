"""A query for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.functions import expressions as X
from fluvia.operators.flow import Flow
from fluvia.operators.windows import AllWindow, CountWindow, EventTimeWindow, LastKWindow, ProcessingTimeWindow, SessionWindow, TransactionWindow
from fluvia.plans.tables import TIMED, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000


def add(key: str, make: Callable[[Tables], DataFrame | Flow], sql: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(Tables(spark, sf_dir))
        return out.df if isinstance(out, Flow) else out

    QUERIES[key] = query
    if sql:
        SQL[key] = f"WITH {TIMED} {sql}" if "timed" in sql and not sql.lstrip().upper().startswith("WITH") else sql


n = lambda name="n": F.count(F.lit(1)).alias(name)
events = lambda t, kind: t.timed.filter(F.col("event_type") == kind)

# ---- stateless ---------------------------------------------------------------------------------------------------

add("map", lambda t: t.timed.map("event_id", cents="cents"), "SELECT event_id, cents FROM timed")
add("filter", lambda t: t.timed.filter("cents > 1000").map("event_id", "cents"), "SELECT event_id, cents FROM timed WHERE cents > 1000")
add("filter_map", lambda t: t.timed.filter_map(F.when(F.col("user_id") % 2 == 0, F.col("user_id") * 3), "x"), "SELECT user_id * 3 AS x FROM timed WHERE user_id % 2 = 0")
add("flat_map", lambda t: t.documents.flat_map(X.latin_words("text"), "word", "doc_id"), "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents")
add("flatten", lambda t: t.documents.map("doc_id", items=F.split("text", "\n")).flatten("items", "doc_id"), "SELECT doc_id, unnest(string_split(text, chr(10))) AS items FROM documents")
add("word_count", lambda t: t.documents.flat_map(X.latin_words("text"), "word").group_by_count("word", "n"), "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word")
add("word_count_reduce", lambda t: t.documents.flat_map(X.latin_words("text"), "word").with_columns(one=F.lit(1).cast("bigint")).group_by_reduce("word", F.sum("one").alias("n")), "SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word")
for key, make in {
    "inspect": lambda t: t.timed.inspect("seen", F.count(F.lit(1)).alias("rows")).map("event_id", "cents"),
    "batch_mode": lambda t: t.timed.batch_mode("fixed").map("event_id", "cents"),
    "into_boxed": lambda t: t.timed.into_boxed().map("event_id", "cents"),
    "key_by": lambda t: t.timed.key_by("user_id").df.select("event_id", "cents"),
    "unkey": lambda t: t.timed.group_by("user_id").unkey().map("event_id", "cents"),
    "to_keyed": lambda t: t.timed.to_keyed("user_id").unkey().map("event_id", "cents"),
    "shuffle": lambda t: t.timed.map("event_id", "cents").shuffle(),
    "replication": lambda t: t.timed.map("event_id", "cents").replication(2),
    "repartition_by": lambda t: t.timed.map("event_id", "cents").repartition_by(16, F.col("event_id") % 7),
    "drop_timestamps": lambda t: t.timed.drop_timestamps().map("event_id", "cents"),
    "reorder": lambda t: t.timed.reorder().map("event_id", "cents"),
}.items():
    add(key, make, "SELECT event_id, cents FROM timed")
_keyed = lambda t: t.timed.group_by("user_id")
add("keyed_map", lambda t: _keyed(t).map("event_id", twice=F.col("cents") * 2), "SELECT user_id, event_id, cents * 2 AS twice FROM timed")
add("keyed_filter", lambda t: _keyed(t).filter("cents > 1000").map("event_id"), "SELECT user_id, event_id FROM timed WHERE cents > 1000")
add("keyed_filter_map", lambda t: _keyed(t).filter_map(F.when(F.col("event_id") % 2 == 0, F.col("cents")), "x"), "SELECT user_id, cents AS x FROM timed WHERE event_id % 2 = 0 AND cents IS NOT NULL")
add("keyed_flat_map", lambda t: _keyed(t).flat_map(F.array("event_id", "cents"), "x"), "SELECT user_id, unnest([event_id, cents]) AS x FROM timed")
add("keyed_flatten", lambda t: t.timed.with_columns(xs=F.array("cents", "ms")).group_by("user_id").flatten("xs", "event_id"), "SELECT user_id, event_id, unnest([cents, ms]) AS xs FROM timed")
add("keyed_inspect", lambda t: _keyed(t).inspect("keyed", F.count(F.lit(1)).alias("rows")).map("event_id"), "SELECT user_id, event_id FROM timed")
add("key_by_partition", lambda t: t.timed.key_by("user_id", per_partition=True).fold(F.sum("cents").alias("part")).unkey().group_by("user_id").fold(F.sum("part").alias("total")), "SELECT user_id, CAST(sum(cents) AS BIGINT) AS total FROM timed GROUP BY user_id")
add("euclidean_distance", lambda t: t.timed.map("event_id", d=F.floor(F.sqrt(F.pow(F.col("user_id"), 2) + F.pow(F.col("cents"), 2)))), "SELECT event_id, CAST(floor(sqrt(user_id * user_id + cents * cents)) AS BIGINT) AS d FROM timed")
add("drop_key", lambda t: t.timed.map("user_id", "cents").group_by("user_id").drop_key(), "SELECT cents FROM timed")
add("map_memo", lambda t: t.timed.map("event_id", x="user_id").map_memo(_square_mod, "x", "y", "bigint", 1000), "SELECT event_id, user_id AS x, (user_id * user_id) % 7 AS y FROM timed")
add("map_memo_by", lambda t: t.timed.map("event_id", x=F.col("user_id")).map_memo_by(_square_mod, "x", F.col("x") % 7, "y", "bigint", 7), "SELECT event_id, user_id AS x, (user_id * user_id) % 7 AS y FROM timed")
add("map_async", lambda t: t.timed.map("event_id", x="user_id").map_async(_async_double, "x", "y", "bigint"), "SELECT event_id, user_id AS x, user_id * 2 AS y FROM timed")
add("map_async_memo", lambda t: t.timed.map("event_id", x="user_id").map_async_memo(_async_double, "x", "y", "bigint"), "SELECT event_id, user_id AS x, user_id * 2 AS y FROM timed")


def _square_mod(x: int) -> int:
    return x * x % 7


async def _async_double(x: int) -> int:
    return x * 2


# ---- stateful ----------------------------------------------------------------------------------------------------

add("rich_map_prefix_sum", lambda t: t.timed.group_by("user_id").rich_map(["ms", "event_id"], total=F.sum("cents")).df.select("event_id", "total"), "SELECT event_id, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM timed")
add("rich_map_enumerate", lambda t: t.timed.enumerate("event_id").df.select("event_id", F.col("index").cast("bigint").alias("index")), "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS index FROM timed")
add("running_sums", lambda t: t.timed.running_sums("event_id", total=F.col("cents"), n=F.lit(1).cast("bigint")).df.select("event_id", "total", "n"), "SELECT event_id, CAST(sum(cents) OVER w AS BIGINT) AS total, row_number() OVER w AS n FROM timed WINDOW w AS (ORDER BY event_id)")
add("rich_filter_map_positive_prefix", lambda t: t.timed.with_columns(x=F.col("cents") - 2500).group_by("user_id").rich_filter_map(["ms", "event_id"], F.col("total") > 0, total=F.sum("x")).df.select("event_id", "total"), "SELECT * FROM (SELECT event_id, CAST(sum(cents - 2500) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM timed) WHERE total > 0")
add("rich_flat_map_pairs", lambda t: _earlier_pairs(t), "SELECT a.event_id AS earlier, b.event_id AS later FROM timed a JOIN timed b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.ms - a.ms <= 3600000")
add("rich_map_pandas", lambda t: t.timed.group_by("user_id").rich_map_pandas(_since_last, "user_id bigint, event_id bigint, gap bigint", ["ms", "event_id"]).df.select("event_id", "gap"), "SELECT event_id, ms - coalesce(lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id), ms) AS gap FROM timed")
add("rich_map_custom", lambda t: t.timed.map("event_id", "cents").rich_map_custom(_doubled, "event_id bigint, twice bigint", "event_id"), "SELECT event_id, cents * 2 AS twice FROM timed")


def _earlier_pairs(t: Tables) -> DataFrame:
    a = t.timed.map("user_id", earlier="event_id", at="ms").group_by("user_id")
    b = t.timed.map("user_id", later="event_id", then="ms").group_by("user_id")
    return a.interval_join(b, "at", "then", 0, HOUR).df.where("earlier < later").select("earlier", "later")


def _since_last(rows):
    rows = rows.assign(gap=rows["ms"].diff().fillna(0).astype("int64"))
    return rows[["user_id", "event_id", "gap"]]


def _doubled(parts):
    for p in parts:
        yield p.assign(twice=p["cents"] * 2)[["event_id", "twice"]]


# ---- places and sets ---------------------------------------------------------------------------------------------

add("broadcast", lambda t: t.nation.map("n_nationkey").broadcast(4).df.select("n_nationkey", F.col("replica").cast("bigint").alias("replica")), "SELECT n_nationkey, replica FROM nation, range(4) r(replica)")
add("split", lambda t: _split(t), "SELECT 'clicks' AS part, count(*) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT 'views', count(*) FROM events WHERE event_type = 'view'")
add("route", lambda t: _route(t), "SELECT event_id, CASE WHEN cents < 1000 THEN 0 ELSE 1 END AS branch FROM timed WHERE cents < 1000 OR event_id % 2 = 0")
add("merge", lambda t: events(t, "view").merge(events(t, "click")).map("event_id", "event_type"), "SELECT event_id, event_type FROM timed WHERE event_type IN ('view', 'click')")
add("merge_keyed", lambda t: events(t, "view").group_by("user_id").merge(events(t, "click")).fold(n()), "SELECT user_id, count(*) AS n FROM timed WHERE event_type IN ('view', 'click') GROUP BY user_id")
add("merge_distinct", lambda t: _tagged(t), "SELECT 'L' AS side, CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT 'R', CAST(r_regionkey AS BIGINT) FROM region")
add("unique", lambda t: t.timed.map("user_id", "event_type").unique_assoc(), "SELECT DISTINCT user_id, event_type FROM timed")
add("unique_by_key", lambda t: t.timed.map("user_id", "event_id", "event_type").unique_assoc_by_key("user_id", "event_id"), "SELECT user_id, event_id, event_type FROM timed QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
add("zip", lambda t: events(t, "view").map(view="event_id").zip(events(t, "click").map(click="event_id"), "view", "click"), "SELECT a.event_id AS view, b.event_id AS click FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) i FROM timed WHERE event_type = 'view') a JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) i FROM timed WHERE event_type = 'click') b USING (i)")


def _split(t: Tables) -> Flow:
    a, b = t.events.map("event_type").split(2)
    clicks = a.filter("event_type = 'click'").count_row("n").map(part=F.lit("clicks"), n="n")
    return clicks.merge(b.filter("event_type = 'view'").count_row("n").map(part=F.lit("views"), n="n"))


def _route(t: Tables) -> Flow:
    small, even = t.timed.route().add_route(F.col("cents") < 1000).add_route(F.col("event_id") % 2 == 0).build()
    return small.map("event_id", branch=F.lit(0)).merge(even.map("event_id", branch=F.lit(1)))


def _tagged(t: Tables) -> DataFrame:
    both = t.nation.map("n_nationkey").merge_distinct(t.region.map("r_regionkey")).df
    return both.select("side", F.coalesce("left.n_nationkey", "right.r_regionkey").cast("bigint").alias("id"))


# ---- aggregations ------------------------------------------------------------------------------------------------

add("fold", lambda t: t.timed.fold(F.sum("cents").alias("total"), n()), "SELECT CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM timed")
add("fold_empty", lambda t: t.timed.filter("event_id < 0").fold(F.sum("cents").alias("total")), "SELECT cents AS total FROM timed WHERE event_id < 0")
add("fold_assoc", lambda t: t.timed.fold_assoc(F.sum("cents").alias("total"), n()), "SELECT CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM timed")
add("fold_assoc_pandas", lambda t: t.timed.fold_pandas(_part_sum, _part_total, "total bigint, n bigint"), "SELECT CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM timed")
add("reduce", lambda t: t.timed.reduce(F.max("cents").alias("top")), "SELECT max(cents) AS top FROM timed")
add("reduce_assoc", lambda t: t.timed.reduce_assoc(F.min("cents").alias("low")), "SELECT min(cents) AS low FROM timed")
add("fold_scan", lambda t: t.timed.fold_scan([F.max("cents").alias("top")], "event_id", (F.col("top") - F.col("cents")).alias("below")), "SELECT event_id, max(cents) OVER () - cents AS below FROM timed")
add("reduce_scan", lambda t: t.timed.reduce_scan([F.sum("cents").alias("total"), n()], "event_id", "total", "n"), "SELECT event_id, CAST(sum(cents) OVER () AS BIGINT) AS total, count(*) OVER () AS n FROM timed")
add("keyed_fold_scan", lambda t: t.timed.group_by("user_id").fold_scan({"top": F.max("cents")}, "event_id", (F.col("top") - F.col("cents")).alias("below")), "SELECT user_id, event_id, max(cents) OVER (PARTITION BY user_id) - cents AS below FROM timed")
add("keyed_reduce_scan", lambda t: t.timed.group_by("user_id").reduce_scan({"total": F.sum("cents"), "n": F.count(F.lit(1))}, "event_id", "total", "n"), "SELECT user_id, event_id, CAST(sum(cents) OVER (PARTITION BY user_id) AS BIGINT) AS total, count(*) OVER (PARTITION BY user_id) AS n FROM timed")
add("group_by_fold", lambda t: t.timed.group_by_fold("user_id", F.sum("cents").alias("total"), n()), "SELECT user_id, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM timed GROUP BY user_id")
add("group_by_reduce", lambda t: t.timed.group_by_reduce("event_type", F.max("cents").alias("top")), "SELECT event_type, max(cents) AS top FROM timed GROUP BY event_type")
add("group_by_sum", lambda t: t.timed.group_by_sum("user_id", "cents"), "SELECT user_id, CAST(sum(cents) AS BIGINT) AS sum FROM timed GROUP BY user_id")
add("group_by_avg", lambda t: t.timed.group_by_avg("user_id", F.col("cents").cast("double")).df.select("user_id", F.round("avg", 4).alias("avg")), "SELECT user_id, round(avg(cents), 4) AS avg FROM timed GROUP BY user_id")
add("group_by_count", lambda t: t.timed.group_by_count("event_type"), "SELECT event_type, count(*) AS count FROM timed GROUP BY event_type")
add("group_by_max_element", lambda t: t.timed.group_by_max_element("user_id", "cents", "event_id").df.select("user_id", "event_id", "cents"), "SELECT user_id, event_id, cents FROM timed QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id) = 1")
add("group_by_min_element", lambda t: t.timed.group_by_min_element("user_id", "cents", "event_id").df.select("user_id", "event_id", "cents"), "SELECT user_id, event_id, cents FROM timed QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cents, event_id) = 1")
add("keyed_fold", lambda t: t.timed.map("user_id", "event_id", "event_type").group_by("user_id").fold_ordered(F.substring("event_type", 1, 1), "event_id", F.lit(""), lambda a, x: F.concat(a, x), "types"), "SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) AS types FROM timed GROUP BY user_id")
add("keyed_fold_assoc", lambda t: t.timed.group_by("user_id").fold(F.sum("cents").alias("total")), "SELECT user_id, CAST(sum(cents) AS BIGINT) AS total FROM timed GROUP BY user_id")
add("keyed_fold_assoc_pandas", lambda t: t.timed.map("user_id", "cents").group_by("user_id").fold_pandas(_local_by_user, _final_by_user, "user_id bigint, total bigint"), "SELECT user_id, CAST(sum(cents) AS BIGINT) AS total FROM timed GROUP BY user_id")
add("keyed_reduce", lambda t: t.timed.group_by("user_id").reduce(F.min("cents").alias("low")), "SELECT user_id, min(cents) AS low FROM timed GROUP BY user_id")
add("collect_count", lambda t: t.spark.createDataFrame([(t.timed.collect_count(),)], "count bigint"),
     "SELECT count(*) AS count FROM timed")


def _part_sum(rows):
    import pandas as pd

    return pd.DataFrame({"total": [rows["cents"].sum()], "n": [len(rows)]})


def _part_total(rows):
    import pandas as pd

    return pd.DataFrame({"total": [rows["total"].sum()], "n": [rows["n"].sum()]})


def _local_by_user(rows):
    return rows.groupby("user_id", as_index=False)["cents"].sum().rename(columns={"cents": "total"})


def _final_by_user(rows):
    return rows.groupby("user_id", as_index=False)["total"].sum()


# ---- order -------------------------------------------------------------------------------------------------------

add("sorted_by", lambda t: t.timed.sorted_by(F.desc("cents"), "event_id").map("event_id", "cents"), "SELECT event_id, cents FROM timed ORDER BY cents DESC, event_id")
add("sorted_by_partition", lambda t: t.timed.sorted_by("cents", scope="partition").map("event_id", "cents"), "SELECT event_id, cents FROM timed")
add("limit_offset", lambda t: t.timed.map("event_id").limit(20, 40, "event_id"), "SELECT event_id FROM timed ORDER BY event_id LIMIT 20 OFFSET 40")
add("sorted_limit", lambda t: t.timed.map("event_id", "cents").sorted_limit_by([F.desc("cents"), "event_id"], 25, 5), "SELECT event_id, cents FROM timed ORDER BY cents DESC, event_id LIMIT 25 OFFSET 5")

# ---- joins -------------------------------------------------------------------------------------------------------

_o = lambda t: t.orders.map("o_orderkey", "o_custkey")
_c = lambda t: t.customer.map("c_custkey", "c_nationkey")
_INNER = "SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey"
_LEFT = "SELECT o_orderkey, c_custkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
_FULL = "SELECT o_orderkey, c_custkey, c_nationkey FROM orders FULL JOIN customer ON o_custkey = c_custkey"
_picked = lambda df: (df.df if isinstance(df, Flow) else df).select("o_orderkey", "c_custkey", "c_nationkey")
_with = lambda t: _o(t).join_with(_c(t), "o_custkey", "c_custkey")
_full = lambda t: _o(t).join_with(_c(t), "o_custkey", "c_custkey")
add("join_inner", lambda t: _picked(_o(t).join(_c(t), "o_custkey", "c_custkey")), _INNER)
add("join_left", lambda t: _picked(_o(t).left_join(_c(t), "o_custkey", "c_custkey")), _LEFT)
add("join_outer", lambda t: _picked(_o(t).outer_join(_c(t), "o_custkey", "c_custkey")), _FULL)
for local in ("local_hash", "local_sort_merge"):
    name = "hash" if local == "local_hash" else "sort_merge"
    add(f"join_hash_{name}", lambda t, f=local: _picked(getattr(_with(t).ship_hash(), f)().inner()), _INNER)
    add(f"join_hash_{name}_left", lambda t, f=local: _picked(getattr(_with(t).ship_hash(), f)().left()), _LEFT)
    add(f"join_hash_{name}_outer", lambda t, f=local: _picked(getattr(_full(t).ship_hash(), f)().outer()), _FULL)
    add(f"join_bc_{name}", lambda t, f=local: _picked(getattr(_with(t).ship_broadcast_right(), f)().inner()), _INNER)
    add(f"join_bc_{name}_left", lambda t, f=local: _picked(getattr(_with(t).ship_broadcast_right(), f)().left()), _LEFT)
add("join_null_safe", lambda t: _nullable(t), "SELECT o_orderkey, p_partkey FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS k FROM orders) JOIN (SELECT p_partkey, nullif(p_partkey, 1) AS p FROM part) ON k IS NOT DISTINCT FROM p")
add("keyed_join", lambda t: _picked(_o(t).with_columns(k="o_custkey").group_by("k").join(_c(t).with_columns(k="c_custkey").group_by("k"))), _INNER)
add("keyed_join_outer", lambda t: _picked(_o(t).with_columns(k="o_custkey").group_by("k").join_outer(_c(t).with_columns(k="c_custkey").group_by("k"))), _FULL)
add("self_join", lambda t: t.nation.map("n_regionkey", a="n_nationkey").join(t.nation.map(b="n_nationkey", r="n_regionkey"), "n_regionkey", "r").map("a", "b"), "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y USING (n_regionkey)")
add("interval_join", lambda t: _clicks_and_buys(t, False), "SELECT a.event_id AS click, b.event_id AS buy FROM timed a JOIN timed b ON b.ms BETWEEN a.ms - 60000 AND a.ms + 120000 WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
add("keyed_interval_join", lambda t: _clicks_and_buys(t, True), "SELECT a.event_id AS click, b.event_id AS buy FROM timed a JOIN timed b ON a.user_id = b.user_id AND b.ms BETWEEN a.ms - 3600000 AND a.ms + 7200000 WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
add("window_join", lambda t: _window_join(t), "SELECT a.user_id, a.event_id AS click, b.event_id AS view FROM timed a JOIN timed b ON a.user_id = b.user_id AND a.ms // 3600000 = b.ms // 3600000 WHERE a.event_type = 'click' AND b.event_type = 'view'")


def _nullable(t: Tables) -> DataFrame:
    k = t.orders.map("o_orderkey", k=F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")))
    p = t.part.map("p_partkey", p=F.nullif(F.col("p_partkey"), F.lit(1)))
    return k.join_with(p, "k", "p", null_safe=True).inner().select("o_orderkey", "p_partkey")


def _clicks_and_buys(t: Tables, keyed: bool) -> DataFrame:
    a = events(t, "click").map("user_id", click="event_id", clicked="ms")
    b = events(t, "purchase").map("user_id", buy="event_id", bought="ms")
    if keyed:
        return a.group_by("user_id").interval_join(b.group_by("user_id"), "clicked", "bought", HOUR, 2 * HOUR).df.select("click", "buy")
    return a.map("click", "clicked").interval_join(b.map("buy", "bought"), "clicked", "bought", 60_000, 120_000).df.select("click", "buy")


def _window_join(t: Tables) -> DataFrame:
    a = Flow(events(t, "click").df.select("user_id", F.col("event_id").alias("click"), F.col("ms").alias("at")), "at").group_by("user_id")
    b = Flow(events(t, "view").df.select("user_id", F.col("event_id").alias("view"), F.col("ms").alias("then")), "then").group_by("user_id")
    return a.window_join(EventTimeWindow.tumbling(HOUR), b).df.select("user_id", "click", "view")


# ---- windows -----------------------------------------------------------------------------------------------------

_user = lambda t: t.timed.group_by("user_id")
_out = lambda flow, *cols: flow.df.select("user_id", F.col("window_id").cast("bigint").alias("w"), *cols)
_tumbling = lambda t: _user(t).window(EventTimeWindow.tumbling(HOUR)).order_by("ms", "event_id")
_T = "SELECT user_id, (ms // 3600000) * 3600000 AS w, {} FROM timed GROUP BY user_id, ms // 3600000"
add("event_window_tumbling", lambda t: _out(_tumbling(t).count("n"), "n"), _T.format("count(*) AS n"))
add("event_window_sliding", lambda t: _out(_user(t).window(EventTimeWindow.sliding(HOUR, HOUR // 4)).count("n"), "n"), "SELECT user_id, w, count(*) AS n FROM (SELECT user_id, unnest(generate_series((ms // 900000 - 3) * 900000, (ms // 900000) * 900000, 900000)) AS w FROM timed) GROUP BY user_id, w")
add("event_window_first_aligned", lambda t: _out(_user(t).window(EventTimeWindow.tumbling(HOUR, "first")).count("n"), "n"), "SELECT user_id, w, count(*) AS n FROM (SELECT user_id, (ms - min(ms) OVER (PARTITION BY user_id)) // 3600000 AS w FROM timed) GROUP BY user_id, w")
add("processing_window", lambda t: _out(_user(t).window(ProcessingTimeWindow.tumbling(HOUR)).sum("cents", "total"), "total"), _T.format("CAST(sum(cents) AS BIGINT) AS total"))
add("event_window_timestamps", lambda t: _by_timestamp(t), "SELECT event_type, (epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000) AS w, count(*) AS n FROM events GROUP BY ALL")
_RN = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS rn FROM timed)"
_count = lambda t, w: _user(t).window(w).order_by("ms", "event_id")
add("count_window_tumbling", lambda t: _out(_count(t, CountWindow.tumbling(10)).sum("cents", "total"), "total"), f"SELECT user_id, rn // 10 AS w, CAST(sum(cents) AS BIGINT) AS total FROM {_RN} GROUP BY user_id, rn // 10 HAVING count(*) = 10")
add("count_window_sliding", lambda t: _out(_count(t, CountWindow.sliding(10, 5)).first("event_id", "first"), "first"), f"SELECT user_id, w, min_by(event_id, rn) AS first FROM (SELECT *, unnest(CASE WHEN rn < 5 THEN [rn // 5] ELSE [rn // 5 - 1, rn // 5] END) AS w FROM {_RN}) GROUP BY user_id, w HAVING count(*) = 10")
add("count_window_nonexact", lambda t: _out(_count(t, CountWindow(10, 10, exact=False)).count("n"), "n"), f"SELECT user_id, rn // 10 AS w, count(*) AS n FROM {_RN} GROUP BY user_id, rn // 10")
add("count_window_all", lambda t: t.timed.window_all(CountWindow.tumbling(100)).order_by("event_id").sum("cents", "total").df.select(F.col("window_id").cast("bigint").alias("w"), "total"), "SELECT rn // 100 AS w, CAST(sum(cents) AS BIGINT) AS total FROM (SELECT cents, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM timed) GROUP BY rn // 100 HAVING count(*) = 100")
add("last_k", lambda t: _user(t).window(LastKWindow(3)).order_by("ms", "event_id").running(total=F.sum("cents"), n=F.count(F.lit(1))).df.select("event_id", "total", "n"), "SELECT event_id, CAST(sum(cents) OVER w AS BIGINT) AS total, count(*) OVER w AS n FROM timed WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS 2 PRECEDING)")
_SESSION = "SELECT user_id, w, count(*) AS n FROM (SELECT user_id, CAST(sum(CASE WHEN gap > 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS w FROM (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS gap FROM timed)) GROUP BY user_id, w"
add("session_window", lambda t: _out(_user(t).window(SessionWindow(HOUR // 2)).order_by("ms", "event_id").count("n"), "n"), _SESSION)
add("session_window_timestamps", lambda t: _sessions(t), "SELECT user_id, min(ms) AS first_ms, count(*) AS n FROM (SELECT user_id, ms, sum(CASE WHEN gap > 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS w FROM (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS gap FROM timed)) GROUP BY user_id, w")
add("transaction_window", lambda t: _out(_user(t).window(TransactionWindow(F.col("event_type") == "purchase", F.col("event_type") == "error")).order_by("ms", "event_id").sum("cents", "total"), "total"), "SELECT user_id, w, CAST(sum(cents) AS BIGINT) AS total FROM (SELECT *, CAST(coalesce(sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w FROM timed) GROUP BY user_id, w HAVING bool_or(event_type = 'purchase')")
_UNTIL = "SELECT *, max(CASE WHEN event_type = 'purchase' THEN ms + 3600000 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u, lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS p FROM timed"
add("transaction_window_commit_after", lambda t: _out(_user(t).window(TransactionWindow(F.lit(False), commit_after=F.when(F.col("event_type") == "purchase", F.col("ms") + HOUR))).order_by("ms", "event_id").sum("cents", "total"), "total"), f"SELECT user_id, w, CAST(sum(cents) AS BIGINT) AS total FROM (SELECT *, CAST(sum(CASE WHEN ms > u AND u >= p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS w FROM ({_UNTIL})) GROUP BY user_id, w HAVING bool_or(event_type = 'purchase')")
add("count_window_gaps", lambda t: _out(_count(t, CountWindow(5, 8)).count("n"), "n"), f"SELECT user_id, rn // 5 AS w, count(*) AS n FROM {_RN} GROUP BY user_id, rn // 5 HAVING count(*) = 5")
add("count_window_to_arrow", lambda t: _count(t, CountWindow.tumbling(7)).to_arrow(_arrow_rows, "user_id bigint, rows bigint, total bigint"), f"SELECT user_id, count(*) AS rows, CAST(sum(cents) AS BIGINT) AS total FROM {_RN} GROUP BY user_id, rn // 7 HAVING count(*) = 7")
add("all_window", lambda t: _user(t).window(AllWindow()).max("cents", "top"), "SELECT user_id, max(cents) AS top FROM timed GROUP BY user_id")
add("window_all", lambda t: t.timed.window_all(EventTimeWindow.tumbling(24 * HOUR)).max("cents", "top").df.select(F.col("window_id").cast("bigint").alias("w"), "top"), "SELECT (ms // 86400000) * 86400000 AS w, max(cents) AS top FROM timed GROUP BY ms // 86400000")
add("window_sum", lambda t: _out(_tumbling(t).sum("cents", "x"), "x"), _T.format("CAST(sum(cents) AS BIGINT) AS x"))
add("window_min", lambda t: _out(_tumbling(t).min("cents", "x"), "x"), _T.format("min(cents) AS x"))
add("window_max", lambda t: _out(_tumbling(t).max("cents", "x"), "x"), _T.format("max(cents) AS x"))
add("window_min_by", lambda t: _out(_tumbling(t).min_by("event_id", "cents", "x"), "x"), _T.format("first(event_id ORDER BY cents, ms, event_id) AS x"))
add("window_max_by", lambda t: _out(_tumbling(t).max_by("event_id", "cents", "x"), "x"), _T.format("first(event_id ORDER BY cents DESC, ms, event_id) AS x"))
add("window_first", lambda t: _out(_tumbling(t).first("event_id", "x"), "x"), _T.format("first(event_id ORDER BY ms, event_id) AS x"))
add("window_last", lambda t: _out(_tumbling(t).last("event_id", "x"), "x"), _T.format("last(event_id ORDER BY ms, event_id) AS x"))
add("window_to_vec", lambda t: _out(_tumbling(t).to_vec("event_id", "x"), F.concat_ws(",", "x").alias("x")), _T.format("string_agg(event_id, ',' ORDER BY ms, event_id) AS x"))
add("window_map", lambda t: _out(_tumbling(t).map(lambda xs: F.size(F.array_distinct(xs)).cast("bigint"), "event_type", "x"), "x"), _T.format("count(DISTINCT event_type) AS x"))
add("window_fold", lambda t: _out(_tumbling(t).fold(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("n")), "total", "n"), _T.format("CAST(sum(cents) AS BIGINT) AS total, count(*) AS n"))
add("window_fold_first", lambda t: _out(_tumbling(t).fold_first("cents", lambda a, x: F.greatest(a, x), "x"), "x"), _T.format("max(cents) AS x"))
add("window_to_arrow", lambda t: _tumbling(t).to_arrow(_arrow_rows, "user_id bigint, rows bigint, total bigint"), "SELECT user_id, count(*) AS rows, CAST(sum(cents) AS BIGINT) AS total FROM timed GROUP BY user_id, ms // 3600000")


def _by_timestamp(t: Tables) -> DataFrame:
    from fluvia.plans.tables import epoch_ms

    flow = Flow(t.events.df.select("event_type", "ts"), "ts").group_by("event_type").window(EventTimeWindow.tumbling("1 hour")).count("n")
    return flow.df.select("event_type", epoch_ms(F.col("window_id.start")).alias("w"), "n")


def _sessions(t: Tables) -> DataFrame:
    from fluvia.plans.tables import epoch_ms

    flow = Flow(t.events.df.select("user_id", "ts"), "ts").group_by("user_id").window(SessionWindow("30 minutes")).fold(F.min(epoch_ms("ts")).alias("first_ms"), n())
    return flow.df.select("user_id", "first_ms", "n")


def _arrow_rows(rows):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pa.table({"user_id": [rows["user_id"][0].as_py()], "rows": [rows.num_rows], "total": [pc.sum(rows["cents"]).as_py()]})
