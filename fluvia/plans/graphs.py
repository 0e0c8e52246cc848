"""Loops and graph workloads, in whole numbers so that results are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.expressions import collatz_steps
from fluvia.operators.checkpoints import cut
from fluvia.operators.flow import Flow
from fluvia.plans.catalogue import add
from fluvia.plans.tables import EDGES, Tables

#: PageRank in millionths: a rank's base and the share that is passed on, in per cent.
BASE, PASSED, ROUNDS = 150_000, 85, 5


def pagerank(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, rank) after some rounds over directed edges (a, b); rank that a node without edges out holds is not passed on."""
    edges = edges.persist()
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("out"))
    linked = edges.join(degree, "a").persist()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().persist()
    ranks = nodes.withColumn("rank", F.lit(1_000_000).cast("bigint"))
    for k in range(rounds):
        shares = linked.join(ranks, F.col("a") == F.col("node")).groupBy("b").agg(F.sum(F.floor(F.col("rank") / F.col("out"))).alias("got"))
        ranks = nodes.join(shares, F.col("node") == F.col("b"), "left").select("node", (BASE + F.floor(F.coalesce("got", F.lit(0)) * PASSED / 100)).cast("bigint").alias("rank"))
        if k % 3 == 2:
            ranks = cut(ranks)
    return ranks


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that undirected edges (a, b) reach.

    Large-star and small-star steps in turn: each links nodes to the smallest neighbour by a combined minimum and a join, so
    rounds grow with the logarithm of the longest path.
    """
    own = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(most_rounds):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        links = cut(wide.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct())
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return own.join(links, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("label"))


def transitive_closure(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """All (a, b) that a path joins, without self loops. Paths double in each round."""
    paths = cut(edges.where("a <> b").select("a", "b").distinct())
    count = paths.count()
    for _ in range(most_rounds):
        longer = paths.join(paths.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").where("a <> c").select("a", F.col("c").alias("b"))
        paths = cut(paths.union(longer).distinct())
        now = paths.count()
        if now == count:
            return paths
        count = now
    raise RuntimeError("the closure did not settle")


def triangles(edges: DataFrame, most_told: int = 1 << 19) -> DataFrame:
    """(x, y, z), x < y < z, joined pairwise by undirected edges (a, b).

    Edges lead to the end of higher degree, so a node is the start of at most sqrt(2 edges) of them, however many it has. The third
    node of a triangle that starts u, v is sought among the ends of whichever of u and v starts fewer edges: the pairs that are looked
    up are the sum of those smaller numbers over all edges. Nothing is written but shuffles of edges and pairs.

    Degrees of the highest nodes, `most_told` at most, are broadcast and give the direction of every edge at one of them; the degrees
    of other edges' ends are joined.
    """
    e = edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("x <> y").distinct()
    degree = e.select(F.explode(F.array("x", "y")).alias("n")).where("n IS NOT NULL").groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    bits = F.length(F.bin("d"))
    sizes = degree.groupBy(bits.alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.sum("n").over(Window.orderBy(F.desc("b"))))  # 63 rows at most
    high = F.broadcast(degree.crossJoin(F.broadcast(sizes.where(F.col("n") <= most_told).agg(F.min("b").alias("b")))).where(bits >= F.col("b")))
    by = lambda d, end: d.select(F.col("n").alias(end), F.col("d").alias(f"d{end}"))
    marked = e.join(F.broadcast(by(high, "x")), "x", "left").join(F.broadcast(by(high, "y")), "y", "left").select("x", "y", "dx", "dy")
    told = marked.where("dx IS NOT NULL OR dy IS NOT NULL").select("x", "y", F.coalesce("dx", F.lit(0)).alias("dx"), F.coalesce("dy", F.lit(0)).alias("dy"))
    rest = marked.where("dx IS NULL AND dy IS NULL").select("x", "y").join(by(degree, "x"), "x").join(by(degree, "y"), "y")
    ends = told.unionByName(rest)
    first = F.struct("dx", "x") < F.struct("dy", "y")
    led = ends.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("u"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("v"), F.greatest("dx", "dy").alias("dv"))
    led = led.where("u IS NOT NULL AND v IS NOT NULL").repartition("u")  # always true; so, and as all columns are read, every use below reads the same exchange
    own = Window.partitionBy("u").orderBy("dv", "v")
    started = led.withColumns({"k": F.row_number().over(own), "out": F.count(F.lit(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    starts = started.where("k = 1").select(F.col("u").alias("v"), F.col("out").alias("out_v"))
    both = started.drop("k").join(starts, "v", "left")
    third = led.select("u", F.col("v").alias("w"), F.col("dv").alias("dw"))
    later = F.struct("dv", "v") < F.struct("dw", "w")
    on_v = both.where("out_v <= out").join(third.withColumnRenamed("u", "v"), "v").where(later).select(F.col("u").alias("p"), F.col("w").alias("q"), F.col("v").alias("r"))
    on_u = both.where("out_v > out AND out_v * (out - 1) > 0").join(third, "u").where(later).select(F.col("v").alias("p"), F.col("w").alias("q"), F.col("u").alias("r"))
    pairs = on_v.union(on_u).select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "r")
    return pairs.join(e, ["x", "y"]).select(F.array_sort(F.array("x", "y", "r")).alias("t")).select(F.col("t")[0].alias("x"), F.col("t")[1].alias("y"), F.col("t")[2].alias("z"))


def kmeans(points: DataFrame, start: list[tuple[int, int]], rounds: int) -> list[tuple[int, int]]:
    """Centres after some rounds over points (x, y) in whole numbers, means rounded down; a centre without points stays.

    Centres are a few numbers in the plan; each round is one map-side combined aggregate, a row a centre.
    """
    flow = Flow(points)

    def nearest(df: DataFrame, centres: list[tuple[int, int]]) -> DataFrame:
        far = [((F.col("x") - a) * (F.col("x") - a) + (F.col("y") - b) * (F.col("y") - b)) for a, b in centres]
        best: Column = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(far))))["k"]
        sums = df.groupBy(best.alias("k")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
        return sums.agg(F.collect_list(F.struct("k", "x", "y", "n")).alias("c"))

    def moved(centres: list[tuple[int, int]], row) -> list[tuple[int, int]]:
        got = {r["k"]: (r["x"] // r["n"], r["y"] // r["n"]) for r in row["c"]}
        return [got.get(k, c) for k, c in enumerate(centres)]

    return flow.replay(rounds, start, nearest, lambda df: df, moved)


def _owners(t: Tables) -> DataFrame:
    """Order to customer to nation to region; a node's last digit tells its kind."""
    orders = t.orders.df.selectExpr("o_orderkey * 10 + 3 AS a", "o_custkey * 10 + 2 AS b")
    customers = t.customer.df.selectExpr("c_custkey * 10 + 2 AS a", "c_nationkey * 10 + 1 AS b")
    return orders.union(customers).union(t.nation.df.selectExpr("n_nationkey * 10 + 1 AS a", "n_regionkey * 10 AS b"))


def _trade(t: Tables) -> DataFrame:
    """Suppliers with their parts and nations, and parts with the nations that bought them; a node's last digit tells its kind."""
    nations = t.orders.df.join(t.customer.df, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")  # before the longest table
    bought = t.lineitem.df.join(nations, F.col("l_orderkey") == F.col("o_orderkey"))
    supplied = t.lineitem.df.selectExpr("l_suppkey * 10 AS a", "l_partkey * 10 + 1 AS b")
    return supplied.union(t.supplier.df.selectExpr("s_suppkey * 10 AS a", "s_nationkey * 10 + 2 AS b")).union(bought.selectExpr("l_partkey * 10 + 1 AS a", "c_nationkey * 10 + 2 AS b"))


_OWNERS = "owners AS (SELECT o_orderkey * 10 + 3 AS a, o_custkey * 10 + 2 AS b FROM orders UNION ALL SELECT c_custkey * 10 + 2, c_nationkey * 10 + 1 FROM customer UNION ALL SELECT n_nationkey * 10 + 1, n_regionkey * 10 FROM nation)"
_TRADE = "trade AS (SELECT l_suppkey * 10 AS a, l_partkey * 10 + 1 AS b FROM lineitem UNION ALL SELECT s_suppkey * 10, s_nationkey * 10 + 2 FROM supplier UNION ALL SELECT l_partkey * 10 + 1, c_nationkey * 10 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def _components_sql(rounds: int) -> str:
    """Nodes take the smallest label next to them; of suppliers and parts none is more than a few steps from any other."""
    parts = [EDGES, "both_ways AS MATERIALIZED (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)", "l0 AS (SELECT DISTINCT a AS node, a AS label FROM both_ways)"]
    parts += [f"l{k + 1} AS MATERIALIZED (SELECT a AS node, least(a, min(label)) AS label FROM both_ways JOIN l{k} ON b = node GROUP BY a)" for k in range(rounds)]
    return f"WITH {', '.join(parts)} SELECT node, min(label) AS label FROM (SELECT * FROM l{rounds} UNION ALL SELECT * FROM l{rounds - 1}) GROUP BY node"


def _pagerank_sql() -> str:
    parts = [EDGES, "d AS (SELECT a, count(*) AS out FROM edges GROUP BY a)", "nodes AS (SELECT DISTINCT node FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges))", "r0 AS (SELECT node, 1000000 AS rank FROM nodes)"]
    for k in range(ROUNDS):
        parts.append(f"s{k} AS (SELECT b, sum(rank // out) AS got FROM edges JOIN d USING (a) JOIN r{k} ON a = node GROUP BY b)")
        parts.append(f"r{k + 1} AS (SELECT node, CAST({BASE} + coalesce(got, 0) * {PASSED} // 100 AS BIGINT) AS rank FROM nodes LEFT JOIN s{k} ON node = b)")
    return f"WITH {', '.join(parts)} SELECT node, rank FROM r{ROUNDS}"


def _kmeans_sql(start: list[tuple[int, int]], rounds: int) -> str:
    parts = ["points AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS x, (epoch_us(ts) // 1000) % 86400000 // 10000 AS y FROM events)", "c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(start)) + ") v(k, cx, cy))"]
    for r in range(rounds):
        parts.append(f"a{r} AS (SELECT x, y, k FROM points, c{r} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), k) = 1)")
        parts.append(f"m{r} AS (SELECT k, CAST(sum(x) AS BIGINT) // count(*) AS cx, CAST(sum(y) AS BIGINT) // count(*) AS cy FROM a{r} GROUP BY k)")
        parts.append(f"c{r + 1} AS (SELECT c.k, coalesce(m.cx, c.cx) AS cx, coalesce(m.cy, c.cy) AS cy FROM c{r} c LEFT JOIN m{r} m USING (k))")
    return f"WITH {', '.join(parts)} SELECT CAST(k AS BIGINT) AS k, CAST(cx AS BIGINT) AS x, CAST(cy AS BIGINT) AS y FROM c{rounds}"


_START = [(500, 1000), (2000, 3000), (5000, 5000), (9000, 8000)]


def _kmeans(t: Tables) -> DataFrame:
    points = t.timed.df.select(F.col("cents").alias("x"), F.floor(F.col("ms") % 86_400_000 / 10_000).cast("bigint").alias("y"))
    centres = kmeans(points, _START, 3)
    return t.spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(centres)], "k bigint, x bigint, y bigint")


def _iterated(t: Tables) -> DataFrame:
    rows = t.nation.map(x=F.col("n_nationkey").cast("bigint"))
    state, out = rows.iterate(5, 0, lambda df, s: df.select((F.col("x") + s).alias("x")), lambda df: df.agg(F.sum("x").alias("s")), lambda s, r: s + r["s"])
    return out.df.select("x", F.lit(state).cast("bigint").alias("state"))


def _replayed(t: Tables) -> DataFrame:
    rows = t.nation.map(x=F.col("n_nationkey").cast("bigint"))
    state = rows.replay(5, 1, lambda df, s: df.select((F.col("x") * s).alias("x")), lambda df: df.agg(F.sum("x").alias("s")), lambda s, r: (s + r["s"]) % 1000 + 1)
    return t.spark.createDataFrame([(state,)], "state bigint")


def _nested(t: Tables) -> DataFrame:
    """A loop in a loop: the inner one adds the outer state three times."""
    rows = t.region.map(x=F.col("r_regionkey").cast("bigint"))

    def body(df: DataFrame, s: int) -> DataFrame:
        inner = Flow(df).iterate(3, s, lambda d, k: d.select((F.col("x") + k).alias("x")), lambda d: d.agg(F.count(F.lit(1)).alias("n")), lambda k, r: k + 1)
        return inner[1].df

    state, out = rows.iterate(2, 1, body, lambda df: df.agg(F.max("x").alias("m")), lambda s, r: r["m"])
    return out.df.select("x", F.lit(state).cast("bigint").alias("state"))


def _delta(t: Tables) -> DataFrame:
    """Shortest hops from the smallest supplier, as a loop over changed states."""
    both = _both_ways(t).persist()
    start = both.agg(F.min("a").alias("s"))
    nodes = both.select(F.col("a").alias("node")).distinct().crossJoin(F.broadcast(start)).select("node", F.when(F.col("node") == F.col("s"), 0).cast("bigint").alias("hops"))

    def body(state: DataFrame) -> DataFrame:
        return both.join(state.where("hops IS NOT NULL"), F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg((F.min("hops") + 1).alias("near"))

    out = Flow(nodes).group_by("node").delta_iterate(30, body=body, process={"hops": F.least("old_hops", "near")}, output=[F.col("hops")], changed=~F.col("old_hops").eqNullSafe(F.col("hops")))
    return out.df


def _both_ways(t: Tables) -> DataFrame:
    e = t.edges.df
    return e.union(e.select("b", "a"))


def _unrolled(rounds: int) -> str:
    parts = ["r0 AS (SELECT CAST(n_nationkey AS HUGEINT) AS x FROM nation)", "s0 AS (SELECT CAST(0 AS HUGEINT) AS s)"]
    for k in range(rounds):
        parts += [f"r{k + 1} AS (SELECT x + s AS x FROM r{k}, s{k})", f"s{k + 1} AS (SELECT (SELECT s FROM s{k}) + sum(x) AS s FROM r{k + 1})"]
    return f"WITH {', '.join(parts)} SELECT CAST(x AS BIGINT) AS x, CAST(s AS BIGINT) AS state FROM r{rounds}, s{rounds}"


def _replay_sql(rounds: int) -> str:
    parts = ["s0 AS (SELECT CAST(1 AS BIGINT) AS s)"]
    parts += [f"s{k + 1} AS (SELECT (s + (SELECT CAST(sum(n_nationkey) AS BIGINT) FROM nation) * s) % 1000 + 1 AS s FROM s{k})" for k in range(rounds)]
    return f"WITH {', '.join(parts)} SELECT CAST(s AS BIGINT) AS state FROM s{rounds}"


add("pagerank", lambda t: pagerank(t.edges.df), _pagerank_sql())
add("connected_components", lambda t: components(t.edges.df), _components_sql(12))
add("transitive_closure", lambda t: transitive_closure(_owners(t)), f"WITH RECURSIVE {_OWNERS}, paths(a, b) AS (SELECT a, b FROM owners UNION SELECT paths.a, owners.b FROM paths JOIN owners ON paths.b = owners.a) SELECT a, b FROM paths WHERE a <> b")
add("triangles", lambda t: triangles(_trade(t)), f"WITH {_TRADE}, e AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM trade) SELECT p.x, p.y, q.y AS z FROM e p JOIN e q ON p.y = q.x JOIN e r ON r.x = p.x AND r.y = q.y")
add("kmeans", _kmeans, _kmeans_sql(_START, 3))
add("collatz", lambda t: t.part.map(x="p_partkey").with_columns(steps=collatz_steps(F.col("x"))).reduce_assoc(F.max(F.struct("steps", -F.col("x"))).alias("m")).map(steps=F.col("m.steps"), x=-F.col("m.col2")), "WITH RECURSIVE c(x, v, steps) AS (SELECT p_partkey, p_partkey, CAST(0 AS BIGINT) FROM part UNION ALL SELECT x, CASE WHEN v % 2 = 0 THEN v // 2 ELSE 3 * v + 1 END, steps + 1 FROM c WHERE v > 1) SELECT max(steps) AS steps, arg_max(x, steps * 1000000000000 - x) AS x FROM c")
add("iterate_state", _iterated, _unrolled(5))
add("replay_state", _replayed, _replay_sql(5))
add("iterate_nested", _nested, "WITH one AS (SELECT CAST(r_regionkey AS BIGINT) + 6 AS x FROM region), two AS (SELECT x + 3 * (SELECT max(x) FROM one) + 3 AS x FROM one) SELECT CAST(x AS BIGINT) AS x, CAST((SELECT max(x) FROM two) AS BIGINT) AS state FROM two")
add("delta_iterate", _delta, f"WITH RECURSIVE {EDGES}, e AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), h(node, hops) AS (SELECT min(a), CAST(0 AS BIGINT) FROM e UNION SELECT e.b, h.hops + 1 FROM h JOIN e ON h.node = e.a WHERE h.hops < 12) SELECT n.node, min(h.hops) AS hops FROM (SELECT DISTINCT a AS node FROM e) n LEFT JOIN h ON n.node = h.node GROUP BY n.node")
