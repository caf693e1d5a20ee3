"""One query for each dataflow operator of the relational library, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import lineitem_dates, table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def first_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(10)


def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A narrowed scan with a repeatable LIMIT (the first rows by the columns' order)."""
    return table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"], limit=1000)


def project_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(12,2)"))
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", price.cast("double").alias("disc_price"), F.substring("l_returnflag", 1, 1).alias("flag"), F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).alias("ship_day"))


def days_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    return _orders(spark, sf_dir).select("o_orderkey", F.date_from_unix_date(days).cast("string").alias("ordered"))


def filter_range_and_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-open range of dates, one column against another, an inclusive range and a list."""
    lines = lineitem_dates(table(spark, sf_dir, "lineitem"))
    ship = F.col("l_shipdate")
    kept = (ship >= F.lit("1996-01-01").cast("timestamp_ntz")) & (ship < F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_commitdate") < F.col("l_receiptdate"))
    return lines.where(kept & F.col("l_quantity").between(5, 20) & F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_commitdate").cast("string").alias("committed"), F.col("l_receiptdate").cast("string").alias("received"))


def flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


def enumerate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_acctbal", "c_custkey")
    return R.enumerated(people, ["c_acctbal", "c_custkey"])


def zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = R.enumerated(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])
    sellers = R.enumerated(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])
    return R.zipped(people, sellers)


def set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = _orders(spark, sf_dir).select(F.col("o_custkey").alias("k"), "o_orderpriority")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return R.set_join(ordered, people, ["k"])


def multiset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = _orders(spark, sf_dir).select(F.col("o_custkey").alias("k"), "o_orderpriority")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return R.multiset_join(ordered, people, ["k"])


def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables whose size does not depend on the scale."""
    return table(spark, sf_dir, "nation").select("n_name").crossJoin(F.broadcast(table(spark, sf_dir, "region").select("r_name")))


def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return R.anti_join(_orders(spark, sf_dir).select("o_custkey", "o_orderpriority"), gone, ["o_custkey"])


def merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    odd, even = R.partition(keys, F.col("k") % 2 == 1)
    return R.merge_sorted(odd, even, ["k"])


def keyed_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reduce_by_key(_orders(spark, sf_dir), ["o_orderpriority"], n=F.count("*"), dearest=F.max("o_totalprice"))


def global_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).agg(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("total"), F.count("*").alias("n"))


def fold_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = R.collected(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_name"], "n_nationkey", "nations")
    return ordered.select("n_regionkey", F.array_join(F.col("nations").cast("array<string>"), ",").alias("nations"))


def arg_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest order of each customer; ties go to the lowest key."""
    best = F.min(F.struct("o_totalprice", "o_orderkey"))
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


def sort_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


def delta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _orders(spark, sf_dir).select("o_custkey")
    return R.delta(keys, _orders(spark, sf_dir).where("o_orderkey % 2 = 0").select("o_custkey"))


def partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cheap, dear = R.partition(_orders(spark, sf_dir), F.col("o_totalprice") < 250000)
    side = lambda df, name: df.select(F.lit(name).alias("side"), "o_orderkey")
    return side(cheap, "cheap").unionByName(side(dear, "dear"))


def demux_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.demux(_orders(spark, sf_dir), {"status": [F.lit("status").alias("kind"), F.col("o_orderstatus").alias("v")], "priority": [F.lit("priority").alias("kind"), F.col("o_orderpriority").alias("v")]})
    return out["status"].unionByName(out["priority"]).groupBy("kind", "v").agg(F.count("*").alias("n"))


def assert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.asserted(_orders(spark, sf_dir), F.col("o_totalprice") > 0, "a price must be positive").select("o_orderkey")


def observe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.observed(_orders(spark, sf_dir), "orders_seen", n=F.count(F.lit(1))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def routed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt by key, counted where they are, then once more: two-phase aggregation over an explicit exchange."""
    return R.routed(_orders(spark, sf_dir), 16, "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


QUERIES = {
    f"op_{f.__name__}": f
    for f in (
        first_ten, scan_limit, project_arithmetic, days_to_date, filter_range_and_columns, flat_map, enumerate_rows, zip_rows, set_join, multiset_join, cross_join, anti_join, merge_sorted, keyed_fold,
        global_reduce, fold_to_list, arg_min, sort_top, union_all, delta_rows, partition_rows, demux_rows, assert_rows, observe_rows, routed_counts,
    )
}
ORACLES = {
    "op_first_ten": "SELECT range AS id FROM range(10)",
    "op_scan_limit": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY 1, 2 LIMIT 1000",
    "op_project_arithmetic": """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE) AS disc_price,
  substr(l_returnflag, 1, 1) AS flag, CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS INT) AS ship_day FROM lineitem""",
    "op_days_to_date": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS ordered FROM orders",
    "op_filter_range_and_columns": """WITH l AS (SELECT *, CAST(l_shipdate AS DATE) + CAST(((l_orderkey * 7 + l_linenumber * 13) % 61) - 30 AS INT) AS l_commitdate,
  CAST(l_shipdate AS DATE) + CAST(1 + (l_orderkey * 11 + l_linenumber * 3) % 30 AS INT) AS l_receiptdate FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_commitdate AS VARCHAR) AS committed, CAST(l_receiptdate AS VARCHAR) AS received FROM l WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
  AND l_commitdate < l_receiptdate AND l_quantity BETWEEN 5 AND 20 AND l_returnflag IN ('A', 'R')""",
    "op_flat_map": "SELECT vec_id, pos, CAST(embedding[pos + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(pos)",
    "op_enumerate_rows": "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos, c_acctbal, c_custkey FROM customer",
    "op_zip_rows": """SELECT pos, c_custkey, s_suppkey FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey FROM customer)
  JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_suppkey FROM supplier) USING (pos)""",
    "op_set_join": "SELECT DISTINCT o_custkey AS k, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "op_multiset_join": "SELECT o_custkey AS k, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "op_cross_join": "SELECT n_name, r_name FROM nation, region",
    "op_anti_join": "SELECT o_custkey, o_orderpriority FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    "op_merge_sorted": "SELECT c_custkey AS k FROM customer ORDER BY 1",
    "op_keyed_fold": "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS dearest FROM orders GROUP BY 1",
    "op_global_reduce": "SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total, count(*) AS n FROM orders",
    "op_fold_to_list": "SELECT n_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name, n_nationkey) AS nations FROM nation GROUP BY 1",
    "op_arg_min": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1",
    "op_sort_top": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "op_union_all": "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "op_delta_rows": "SELECT o_custkey FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0",
    "op_partition_rows": "SELECT CASE WHEN o_totalprice < 250000 THEN 'cheap' ELSE 'dear' END AS side, o_orderkey FROM orders",
    "op_demux_rows": "SELECT 'status' AS kind, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "op_assert_rows": "SELECT o_orderkey FROM orders",
    "op_observe_rows": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "op_routed_counts": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
}
