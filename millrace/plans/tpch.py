"""The three warehouse queries: pricing summary (1), order priority check (4), discounted revenue (19)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import lineitem_dates, lineitem_shipping, part_container, table


def _money(name: str):
    """Exact decimals, so that a sum does not depend on the order of its rows."""
    return F.col(name).cast("decimal(12,2)")


def q1(spark: SparkSession, sf_dir: str, last_ship: str = "1998-09-02", limit: int | None = None) -> DataFrame:
    columns = ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem", columns, limit).where(F.col("l_shipdate") <= F.lit(last_ship).cast("timestamp_ntz"))
    disc = _money("l_extendedprice") * (1 - _money("l_discount"))
    return (
        lines.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(_money("l_quantity")).cast("double").alias("sum_qty"),
            F.sum(_money("l_extendedprice")).cast("double").alias("sum_base_price"),
            F.sum(disc).cast("double").alias("sum_disc_price"),
            F.sum(disc * (1 + _money("l_tax"))).cast("double").alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


Q1 = """
SELECT l_returnflag, l_linestatus,
  CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base_price,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS sum_disc_price,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) * (1 + CAST(l_tax AS DECIMAL(12,2)))) AS DOUBLE) AS sum_charge,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc,
  count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02'
GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2
"""


def q4(spark: SparkSession, sf_dir: str, start: str = "1993-07-01", months: int = 3) -> DataFrame:
    """Orders of some months with a line received after its commit date, by priority: a left-semi join."""
    lines = lineitem_dates(table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"]))
    late = lines.where("l_commitdate < l_receiptdate").select("l_orderkey")
    first = F.lit(start).cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority"])
    orders = orders.where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < F.add_months(first, months).cast("timestamp_ntz")))
    found = orders.join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return found.groupBy("o_orderpriority").agg(F.count("*").alias("order_count")).orderBy("o_orderpriority")


def _q4_sides(spark: SparkSession, sf_dir: str, start: str, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Orders in the quarter, and the keys of orders with a late line."""
    lines = lineitem_dates(table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"], limit))
    first = F.lit(start).cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority"], limit)
    orders = orders.where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < F.add_months(first, 3).cast("timestamp_ntz")))
    return orders.select("o_orderkey", "o_orderpriority"), lines.where("l_commitdate < l_receiptdate").select("l_orderkey").distinct()


def _counted(found: DataFrame, partial_first: bool) -> DataFrame:
    """Orders by priority; where partial_first is off, rows travel to where their priority is counted, uncounted."""
    if not partial_first:
        found = found.repartition("o_orderpriority")
    return found.groupBy("o_orderpriority").agg(F.count("*").alias("order_count")).orderBy("o_orderpriority")


#: Bytes, as the planner estimates them, up to which a build side goes to every node.
BROADCAST_BYTES = 64 << 20


def q4_broadcast(spark: SparkSession, sf_dir: str, start: str = "1993-07-01", partial_first: bool = True, limit: int | None = None) -> DataFrame:
    """The build side goes to every node, the probe side is dealt to nodes by key. Beyond BROADCAST_BYTES the build side is
    dealt by key too, as in q4_partitioned."""
    orders, late = _q4_sides(spark, sf_dir, start, limit)
    size = int(str(late._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    late = F.broadcast(late) if size <= BROADCAST_BYTES else late
    return _counted(orders.repartition("o_orderkey").join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi"), partial_first)


def q4_partitioned(spark: SparkSession, sf_dir: str, start: str = "1993-07-01", partial_first: bool = True, limit: int | None = None) -> DataFrame:
    """Both sides are dealt by key; each node joins the bucket that it holds."""
    orders, late = _q4_sides(spark, sf_dir, start, limit)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders, late = orders.repartition(n, "o_orderkey"), late.repartition(n, "l_orderkey").hint("shuffle_hash")
    return _counted(orders.join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi"), partial_first)


def q4_exists(spark: SparkSession, sf_dir: str, start: str = "1993-07-01") -> DataFrame:
    """The same as SQL with EXISTS."""
    orders, lines = table(spark, sf_dir, "orders"), lineitem_dates(table(spark, sf_dir, "lineitem"))
    return spark.sql(
        f"""
        SELECT o_orderpriority, count(*) AS order_count FROM {{orders}} o
        WHERE o_orderdate >= TIMESTAMP_NTZ '{start}' AND o_orderdate < TIMESTAMP_NTZ '{start}' + INTERVAL 3 MONTHS
          AND EXISTS (SELECT * FROM {{lines}} l WHERE l.l_orderkey = o.o_orderkey AND l.l_commitdate < l.l_receiptdate)
        GROUP BY o_orderpriority ORDER BY o_orderpriority
        """,
        orders=orders, lines=lines,
    )


_Q4 = """
SELECT o_orderpriority, count(*) AS order_count FROM orders o
WHERE o_orderdate >= DATE '{start}' AND o_orderdate < DATE '{start}' + INTERVAL 3 MONTH AND EXISTS (
  SELECT * FROM lineitem l WHERE l.l_orderkey = o.o_orderkey
    AND CAST(l_shipdate AS DATE) + CAST(((l_orderkey * 7 + l_linenumber * 13) % 61) - 30 AS INT)
      < CAST(l_shipdate AS DATE) + CAST(1 + (l_orderkey * 11 + l_linenumber * 3) % 30 AS INT))
GROUP BY o_orderpriority ORDER BY o_orderpriority
"""

#: Brand, containers, least quantity (and ten more), largest size. Fixed values of the query.
BRANCHES = (
    ("Brand#12", ("SM CASE", "SM BOX", "SM PACK", "SM PKG"), 1, 5),
    ("Brand#23", ("MED BAG", "MED BOX", "MED PKG", "MED PACK"), 10, 10),
    ("Brand#34", ("LG CASE", "LG BOX", "LG PACK", "LG PKG"), 20, 15),
)
#: The supplied parts have no brand 34; 24 stands for it.
SUPPLIED = tuple((b.replace("34", "24"), c, q, s) for b, c, q, s in BRANCHES)


def q19(spark: SparkSession, sf_dir: str, branches=BRANCHES) -> DataFrame:
    """Revenue under a disjunction of conjunctions; one hash join, each side filtered before it."""
    part = part_container(table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_size"]))
    lines = lineitem_shipping(table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"]))
    lines = lines.where(F.col("l_shipmode").isin("AIR", "AIR REG") & (F.col("l_shipinstruct") == "DELIVER IN PERSON"))
    any_branch = F.lit(False)
    for brand, containers, quantity, size in branches:
        any_branch |= (F.col("p_brand") == brand) & F.col("p_container").isin(*containers) & F.col("l_quantity").between(quantity, quantity + 10) & F.col("p_size").between(1, size)
    joined = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).where(any_branch)
    return joined.agg(F.sum(_money("l_extendedprice") * (1 - _money("l_discount"))).cast("double").alias("revenue"))


def q19_or_join(spark: SparkSession, sf_dir: str, branches=BRANCHES) -> DataFrame:
    """The same as SQL: a comma join whose equality stands in every branch of the OR; Spark factors it out."""
    part = part_container(table(spark, sf_dir, "part"))
    lines = lineitem_shipping(table(spark, sf_dir, "lineitem"))
    where = " OR ".join(
        f"(p_partkey = l_partkey AND p_brand = '{b}' AND p_container IN {c} AND l_quantity >= {q} AND l_quantity <= {q} + 10 AND p_size BETWEEN 1 AND {s} AND l_shipmode IN ('AIR', 'AIR REG') AND l_shipinstruct = 'DELIVER IN PERSON')"
        for b, c, q, s in branches
    )
    return spark.sql(f"SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS revenue FROM {{lines}}, {{part}} WHERE {where}", lines=lines, part=part)


def _q19_sql(branches) -> str:
    where = " OR ".join(f"(p_brand = '{b}' AND p_container IN {c} AND l_quantity BETWEEN {q} AND {q + 10} AND p_size BETWEEN 1 AND {s})" for b, c, q, s in branches)
    return f"""
WITH p AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'SM BOX' WHEN 1 THEN 'MED BOX' WHEN 2 THEN 'LG BOX' ELSE 'JUMBO JAR' END AS p_container FROM part),
l AS (SELECT * FROM lineitem WHERE (l_orderkey + l_linenumber) % 4 < 2 AND (l_orderkey * 3 + l_linenumber) % 2 = 0)
SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS revenue
FROM l JOIN p ON p_partkey = l_partkey WHERE {where}
"""


_DISTRIBUTED = {
    f"tpch_q4_{name}{'' if first else '_uncounted'}": partial(query, start="1996-07-01", partial_first=first) for name, query in (("broadcast", q4_broadcast), ("partitioned", q4_partitioned)) for first in (True, False)
}
QUERIES = _DISTRIBUTED | {
    "tpch_q1": q1, "tpch_q4": partial(q4, start="1996-07-01"), "tpch_q4_exists": partial(q4_exists, start="1996-07-01"), "tpch_q4_literal": q4,
    "tpch_q19": partial(q19, branches=SUPPLIED), "tpch_q19_or_join": partial(q19_or_join, branches=SUPPLIED), "tpch_q19_literal": q19,
}
ORACLES = dict.fromkeys(_DISTRIBUTED, _Q4.format(start="1996-07-01")) | {
    "tpch_q1": Q1, "tpch_q4": _Q4.format(start="1996-07-01"), "tpch_q4_exists": _Q4.format(start="1996-07-01"), "tpch_q4_literal": _Q4.format(start="1993-07-01"),
    "tpch_q19": _q19_sql(SUPPLIED), "tpch_q19_or_join": _q19_sql(SUPPLIED), "tpch_q19_literal": _q19_sql(BRANCHES),
}
