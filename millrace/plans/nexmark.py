"""Auction queries 1 to 8 over the supplied tables.

Bids are events (item = user_id, price = value); persons are customers, open auctions are orders, closed auctions are
line items, items are parts. The ordering columns of ties are keys, so results are repeatable.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("itemid"), F.col("value").alias("price"), F.col("event_id").alias("bidder_id"), F.col("ts").alias("bid_time"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, city (nation), state (region), and a synthetic time of registration."""
    people, nations, regions = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    placed = people.join(nations, people.c_nationkey == nations.n_nationkey).join(regions, nations.n_regionkey == regions.r_regionkey)
    joined = F.lit("1995-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=((F.col("c_custkey") * 37) % 57000).cast("int"))
    return placed.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.col("r_name").alias("state"), joined.alias("joined"))


_PERSONS = """persons AS (
  SELECT c_custkey AS id, c_name AS name, n_name AS city, r_name AS state,
    TIMESTAMP '1995-01-01' + to_hours(CAST((c_custkey * 37) % 57000 AS INT)) AS joined
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def open_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").agg(F.count("*").alias("parts"))  # one row
    orders = table(spark, sf_dir, "orders").crossJoin(F.broadcast(parts))
    return orders.select(F.col("o_orderkey").alias("auction_id"), F.col("o_custkey").alias("seller_id"), (F.col("o_orderkey") % F.col("parts")).alias("itemid"), F.col("o_orderdate").alias("opened"))


def q1(spark: SparkSession, sf_dir: str, rate: float) -> DataFrame:
    """Prices in another currency; the rate is the caller's."""
    return bids(spark, sf_dir).select("itemid", F.round(F.col("price") * rate, 4).alias("price"), "bidder_id", "bid_time")


def q2(spark: SparkSession, sf_dir: str, items: tuple[int, ...]) -> DataFrame:
    return bids(spark, sf_dir).where(F.col("itemid").isin(*items)).select("itemid", "price", "bidder_id")


def q3(spark: SparkSession, sf_dir: str, state: str, category: str) -> DataFrame:
    """Sellers of a state who offer items of a category."""
    people = persons(spark, sf_dir).where(F.col("state") == state)
    items = table(spark, sf_dir, "part", ["p_partkey", "p_type"]).where(F.col("p_type") == category)
    auctions = open_auctions(spark, sf_dir)
    return auctions.join(people, auctions.seller_id == people.id).join(items, auctions.itemid == items.p_partkey).select("name", "city", "state", "auction_id")


def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average closing price by category."""
    closed = table(spark, sf_dir, "lineitem", ["l_partkey", "l_extendedprice"])
    items = table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    return closed.join(items, closed.l_partkey == items.p_partkey).groupBy(F.col("p_type").alias("category")).agg(F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))


def _hops(spark: SparkSession, sf_dir: str, size: str, slide: str) -> DataFrame:
    return bids(spark, sf_dir).groupBy(F.window("bid_time", size, slide).alias("w"), "itemid")


def q5(spark: SparkSession, sf_dir: str, size: str, slide: str) -> DataFrame:
    """The items with the most bids in each hopping window."""
    counts = _hops(spark, sf_dir, size, slide).agg(F.count("*").alias("num"))
    most = counts.groupBy("w").agg(F.max("num").alias("most"))
    hot = counts.alias("a").join(most.alias("m"), (F.col("a.w") == F.col("m.w")) & (F.col("a.num") >= F.col("m.most")))
    return hot.select(F.col("a.w.start").alias("starttime"), F.col("a.w.end").alias("endtime"), "itemid", "num")


def q5_sum(spark: SparkSession, sf_dir: str, size: str, slide: str) -> DataFrame:
    """Sum of prices by item and hopping window."""
    sums = _hops(spark, sf_dir, size, slide).agg(F.sum(F.col("price").cast("decimal(12,2)")).cast("double").alias("total"))
    return sums.select(F.col("w.start").alias("starttime"), "itemid", "total")


def _hops_sql(size: int, slide: int) -> str:
    """Hopping windows in seconds: every bid in each window that covers it."""
    return f"""hops AS (
  SELECT user_id AS itemid, value AS price, time_bucket(INTERVAL {slide} SECOND, ts, TIMESTAMP '1970-01-01') - to_seconds(k * {slide}) AS starttime
  FROM events, range({size // slide}) r(k))"""


def _q5_sql(size: int, slide: int) -> str:
    return f"""
WITH {_hops_sql(size, slide)}, counts AS (SELECT starttime, itemid, count(*) AS num FROM hops GROUP BY ALL),
most AS (SELECT starttime, max(num) AS most FROM counts GROUP BY ALL)
SELECT starttime, starttime + INTERVAL {size} SECOND AS endtime, itemid, num FROM counts JOIN most USING (starttime) WHERE num >= most
"""


def q6(spark: SparkSession, sf_dir: str, preceding: int = 10) -> DataFrame:
    """Average of each seller's last sales: the current one and `preceding` before it."""
    last = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(-preceding, 0)
    sales = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"])
    return sales.select(F.col("l_suppkey").alias("seller_id"), "l_orderkey", "l_linenumber", F.round(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).over(last).cast("double") / F.count("*").over(last), 6).alias("avg_price"))


def q7(spark: SparkSession, sf_dir: str, size: str) -> DataFrame:
    """The bids of the highest price in each fixed window."""
    rows = bids(spark, sf_dir).withColumn("w", F.window("bid_time", size))
    best = rows.groupBy("w").agg(F.max("price").alias("best"))
    return rows.alias("b").join(best.alias("m"), (F.col("b.w") == F.col("m.w")) & (F.col("b.price") == F.col("m.best"))).select(F.col("b.w.start").alias("starttime"), "itemid", "price", "bidder_id")


def q8(spark: SparkSession, sf_dir: str, hours: int = 12) -> DataFrame:
    """Persons and auctions of theirs that opened within some hours of their registration, either way."""
    people, auctions = persons(spark, sf_dir), open_auctions(spark, sf_dir)
    span = F.make_dt_interval(hours=F.lit(hours))
    near = (auctions.seller_id == people.id) & (auctions.opened >= people.joined - span) & (auctions.opened <= people.joined + span)
    return people.join(auctions, near).select("id", "name", "auction_id")


QUERIES = {
    "nexmark_q1": partial(q1, rate=0.908), "nexmark_q2": partial(q2, items=(7, 20, 101, 119, 87)), "nexmark_q2_literal": partial(q2, items=(1007, 1020, 2001, 2019, 1087)), "nexmark_q3": partial(q3, state="ASIA", category="PROMO"), "nexmark_q4": q4,
    "nexmark_q5_hour": partial(q5, size="60 minutes", slide="10 minutes"), "nexmark_q5_seconds": partial(q5, size="10 seconds", slide="2 seconds"), "nexmark_q5_sum": partial(q5_sum, size="10 seconds", slide="1 second"),
    "nexmark_q6": q6, "nexmark_q7": partial(q7, size="10 minutes"), "nexmark_q8": q8,
}
_AUCTIONS = "auctions AS (SELECT o_orderkey AS auction_id, o_custkey AS seller_id, o_orderkey % (SELECT count(*) FROM part) AS itemid, o_orderdate AS opened FROM orders)"
ORACLES = {
    "nexmark_q1": "SELECT user_id AS itemid, round(value * 0.908, 4) AS price, event_id AS bidder_id, ts AS bid_time FROM events",
    "nexmark_q2_literal": "SELECT user_id AS itemid, value AS price, event_id AS bidder_id FROM events WHERE user_id IN (1007, 1020, 2001, 2019, 1087)",
    "nexmark_q2": "SELECT user_id AS itemid, value AS price, event_id AS bidder_id FROM events WHERE user_id IN (7, 20, 101, 119, 87)",
    "nexmark_q3": f"WITH {_PERSONS}, {_AUCTIONS} SELECT name, city, state, auction_id FROM auctions JOIN persons ON seller_id = id JOIN part ON itemid = p_partkey WHERE state = 'ASIA' AND p_type = 'PROMO'",
    "nexmark_q4": "SELECT p_type AS category, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type",
    "nexmark_q5_hour": _q5_sql(3600, 600), "nexmark_q5_seconds": _q5_sql(10, 2),
    "nexmark_q5_sum": f"WITH {_hops_sql(10, 1)} SELECT starttime, itemid, CAST(sum(CAST(price AS DECIMAL(12,2))) AS DOUBLE) AS total FROM hops GROUP BY ALL",
    "nexmark_q6": """SELECT l_suppkey AS seller_id, l_orderkey, l_linenumber, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) OVER w AS DOUBLE) / count(*) OVER w, 6) AS avg_price
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)""",
    "nexmark_q7": """WITH b AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS starttime FROM events), m AS (SELECT starttime, max(value) AS best FROM b GROUP BY ALL)
SELECT starttime, user_id AS itemid, value AS price, event_id AS bidder_id FROM b JOIN m USING (starttime) WHERE value = best""",
    "nexmark_q8": f"WITH {_PERSONS}, {_AUCTIONS} SELECT id, name, auction_id FROM persons JOIN auctions ON seller_id = id AND opened BETWEEN joined - INTERVAL 12 HOUR AND joined + INTERVAL 12 HOUR",
}
