"""Nexmark's queries over the driver's tables.

Persons are customers, auctions orders, bids line items: an auction opens at its order's date, closes 60 days later, has the
order's priority as category and half a per cent of the order's total as reserve; a bid is made at its ship date, for its price.
Persons sign up on a day that their key gives. Times are milliseconds, prices whole cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions.expressions import dollars_to_euros
from fluvia.operators.flow import Flow
from fluvia.operators.windows import CountWindow, EventTimeWindow
from fluvia.plans.catalogue import add
from fluvia.plans.tables import Tables, epoch_ms

DAY = 86_400_000
START = 788_918_400_000  # 1995-01-01


def persons(t: Tables) -> Flow:
    df = t.customer.df.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("state"), (F.lit(START) + (F.col("c_custkey") % 2400) * DAY).alias("date_time"))
    return Flow(df, "date_time")


def auctions(t: Tables) -> Flow:
    at = epoch_ms("o_orderdate")
    df = t.orders.df.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seller"), F.col("o_orderpriority").alias("category"), F.round(F.col("o_totalprice") / 2).cast("bigint").alias("reserve"), at.alias("date_time"), (at + 60 * DAY).alias("expires"))
    return Flow(df, "date_time")


def bids(t: Tables) -> Flow:
    df = t.lineitem.df.select(F.col("l_orderkey").alias("auction"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_suppkey").alias("bidder"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"), epoch_ms("l_shipdate").alias("date_time"))
    return Flow(df, "date_time")


def winning_bids(t: Tables) -> Flow:
    """The best valid bid of each auction: the highest, the earliest of equals."""
    a = auctions(t).map(auction_id="id", seller="seller", category="category", reserve="reserve", opens="date_time", expires="expires")
    b = bids(t).map("auction", "line", "price", "date_time")
    valid = b.join(a, "auction", "auction_id").filter((F.col("price") >= F.col("reserve")) & (F.col("date_time") >= F.col("opens")) & (F.col("date_time") < F.col("expires")))
    best = F.max_by(F.struct("seller", "category", "expires", "price"), F.struct("price", -F.col("date_time"), -F.col("line")))
    return Flow(valid.group_by("auction").fold(best.alias("w")).df.select("auction", "w.*"))


_P = f"persons AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS state, {START} + (c_custkey % 2400) * {DAY} AS date_time FROM customer)"
_A = f"auctions AS (SELECT o_orderkey AS id, o_custkey AS seller, o_orderpriority AS category, CAST(round(o_totalprice / 2) AS BIGINT) AS reserve, (epoch_us(o_orderdate) // 1000) AS date_time, (epoch_us(o_orderdate) // 1000) + {60 * DAY} AS expires FROM orders)"
_B = "bids AS (SELECT l_orderkey AS auction, CAST(l_linenumber AS BIGINT) AS line, l_suppkey AS bidder, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, (epoch_us(l_shipdate) // 1000) AS date_time FROM lineitem)"
_W = "winning AS (SELECT auction, seller, category, expires, price FROM bids JOIN auctions ON auction = id WHERE price >= reserve AND bids.date_time >= auctions.date_time AND bids.date_time < expires QUALIFY row_number() OVER (PARTITION BY auction ORDER BY price DESC, bids.date_time, line) = 1)"


def q5(t: Tables) -> DataFrame:
    """Auctions with the most bids of each sliding window; all of equals."""
    counts = bids(t).group_by("auction").window(EventTimeWindow.sliding(10 * DAY, 2 * DAY)).count("n").df
    top = counts.groupBy("window_id").agg(F.max("n").alias("top"))
    return counts.join(top, "window_id").where("n = top").select(F.col("window_id").alias("w"), "auction", "n")


def q6(t: Tables) -> DataFrame:
    """Mean price of each seller's last ten closed auctions, once there are ten."""
    last = winning_bids(t).group_by("seller").window(CountWindow.sliding(10, 1)).order_by("expires", "auction").sum("price", "total")
    return last.df.select("seller", F.col("window_id").cast("bigint").alias("w"), "total")


def q8(t: Tables) -> DataFrame:
    """Persons who opened an auction in the window in which they signed up."""
    p = Flow(persons(t).df.select(F.col("id").alias("person"), "name", F.col("date_time").alias("signed")), "signed").group_by("person")
    a = Flow(auctions(t).df.select("seller", F.col("id").alias("auction"), F.col("date_time").alias("opened")), "opened").group_by("seller")
    return p.window_join(EventTimeWindow.tumbling(30 * DAY), a).df.select("person", "name", "auction")


add("nexmark_q0", lambda t: bids(t), f"WITH {_B} SELECT * FROM bids")
add("nexmark_q1", lambda t: bids(t).map("auction", "line", euros=dollars_to_euros("price")), f"WITH {_B} SELECT auction, line, CAST(trunc(CAST(price AS FLOAT) * CAST(0.908 AS FLOAT)) AS BIGINT) AS euros FROM bids")
add("nexmark_q2", lambda t: bids(t).filter("auction % 123 = 0").map("auction", "price"), f"WITH {_B} SELECT auction, price FROM bids WHERE auction % 123 = 0")
add("nexmark_q3", lambda t: auctions(t).filter("category = '1-URGENT'").map(auction="id", seller="seller").join(persons(t).filter(F.col("state").isin("BUILDING", "MACHINERY")).map("id", "name", "state"), "seller", "id").map("name", "state", "auction"), f"WITH {_P}, {_A} SELECT name, state, a.id AS auction FROM auctions a JOIN persons p ON seller = p.id WHERE category = '1-URGENT' AND state IN ('BUILDING', 'MACHINERY')")
add("nexmark_q4", lambda t: winning_bids(t).group_by_fold("category", F.sum("price").alias("total"), F.count(F.lit(1)).alias("n")), f"WITH {_A}, {_B}, {_W} SELECT category, CAST(sum(price) AS BIGINT) AS total, count(*) AS n FROM winning GROUP BY category")
add("nexmark_q5", q5, f"WITH {_B}, c AS (SELECT w, auction, count(*) AS n FROM (SELECT auction, unnest(generate_series((date_time // {2 * DAY} - 4) * {2 * DAY}, (date_time // {2 * DAY}) * {2 * DAY}, {2 * DAY})) AS w FROM bids) GROUP BY w, auction) SELECT w, auction, n FROM c QUALIFY n = max(n) OVER (PARTITION BY w)")
add("nexmark_q6", q6, f"WITH {_A}, {_B}, {_W}, r AS (SELECT seller, row_number() OVER p - 1 AS rn, sum(price) OVER (PARTITION BY seller ORDER BY expires, auction ROWS 9 PRECEDING) AS total FROM winning WINDOW p AS (PARTITION BY seller ORDER BY expires, auction)) SELECT seller, rn - 9 AS w, CAST(total AS BIGINT) AS total FROM r WHERE rn >= 9")
add("nexmark_q7", lambda t: _q7(t), f"WITH {_B} SELECT (date_time // {10 * DAY}) * {10 * DAY} AS w, auction, line, price FROM bids QUALIFY row_number() OVER (PARTITION BY date_time // {10 * DAY} ORDER BY price DESC, auction, line) = 1")
add("nexmark_q8", q8, f"WITH {_P}, {_A} SELECT p.id AS person, name, a.id AS auction FROM persons p JOIN auctions a ON p.id = a.seller AND p.date_time // {30 * DAY} = a.date_time // {30 * DAY}")


def _q7(t: Tables) -> DataFrame:
    """The highest bid of each window."""
    best = F.max_by(F.struct("auction", "line", "price"), F.struct("price", -F.col("auction"), -F.col("line")))
    out = bids(t).window_all(EventTimeWindow.tumbling(10 * DAY)).fold(best.alias("b"))
    return out.df.select(F.col("window_id").alias("w"), "b.*")
