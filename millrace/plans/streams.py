"""Streaming queries, run to the end of what is available; their SQL is that of the batch form."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import median, nexmark, windows
from ..streaming.runs import drained, newest, shared_folder
from . import nexmark as batch
from . import tpcc


def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(nexmark.convert(nexmark.bid_stream(spark, sf_dir), 0.908), "append").drop("batch")


def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(nexmark.chosen(nexmark.bid_stream(spark, sf_dir), (7, 20, 101, 119, 87)), "append").drop("batch")


def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = drained(nexmark.hop_counts(nexmark.bid_stream(spark, sf_dir), "60 minutes", "10 minutes"), "update")
    counts = newest(counts, "starttime", "itemid")
    most = counts.groupBy("starttime").agg(F.max("num").alias("most"))
    return counts.join(most, "starttime").where("num >= most").select("starttime", "itemid", "num")


def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(drained(nexmark.highest(nexmark.bid_stream(spark, sf_dir), "10 minutes"), "update"), "starttime")


def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both inputs are written out first: a stream reads files."""
    folder = shared_folder(spark)
    people = batch.persons(spark, sf_dir).select("id", "name", F.col("joined").cast("timestamp").alias("joined"))
    auctions = batch.open_auctions(spark, sf_dir).select("seller_id", "auction_id", F.col("opened").cast("timestamp").alias("opened"))
    streams = []
    for name, rows in (("people", people), ("auctions", auctions)):
        rows.write.parquet(f"{folder}/{name}")
        streams.append(spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}"))
    return drained(nexmark.new_sellers(*streams), "append").drop("batch")


def incremental_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: customers whose ids are not divisible by 3, the others, and the deletion of those divisible by 5."""
    people = tpcc.customers(spark, sf_dir)
    folder = f"{shared_folder(spark)}/feed"
    for op, test in (("insert", "c_id % 3 != 0"), ("insert", "c_id % 3 = 0"), ("delete", "c_id % 5 = 0")):
        rows = people.where(test).select(F.lit(op).alias("op"), "c_w_id", "c_d_id", "c_last", "c_first", F.col("c_id").cast("long").alias("c_id"))
        rows.coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(median.FEED).option("maxFilesPerTrigger", 1).parquet(folder)
    return median.latest(drained(median.incremental_median(feed), "update"))


def arrival_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrived in the last half minute, evaluated every minute: the slide is larger than the window."""
    return windows.arrival_window(table(spark, sf_dir, "events"), "ts", "value", timedelta(minutes=1), timedelta(seconds=30))


def live_arrival_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arrival_window() over the events as a stream, with state that is evicted."""
    live = windows.live_arrival_window(nexmark.bid_stream(spark, sf_dir), "bid_time", "price", timedelta(minutes=1), timedelta(seconds=30))
    return newest(drained(live, "update"), "instant")


def concurrent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = {"half": (timedelta(minutes=1), timedelta(seconds=30)), "ten": (timedelta(minutes=1), timedelta(minutes=10))}
    return windows.concurrent_windows(table(spark, sf_dir, "events"), "ts", "value", each)


def _arrival(size: int) -> str:
    """Windows of `size` seconds every minute."""
    return f"""SELECT instant, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events,
  (SELECT TIMESTAMP '2023-12-31 23:00:00' + to_minutes(CAST(k AS BIGINT)) AS instant FROM range(60 * 24 * 33) r(k))
WHERE instant >= ts AND instant <= ts + to_seconds({size}) GROUP BY instant"""


QUERIES = {
    "stream_nexmark_q1": q1, "stream_nexmark_q2": q2, "stream_nexmark_q5": q5, "stream_nexmark_q7": q7, "stream_nexmark_q8": q8, "stream_median": incremental_median,
    "stream_arrival_window": live_arrival_window, "arrival_window": arrival_window, "arrival_windows_concurrent": concurrent_windows,
}
ORACLES = {
    "stream_nexmark_q1": "SELECT user_id AS itemid, round(value * 0.908, 4) AS price, event_id AS bidder_id FROM events",
    "stream_nexmark_q2": batch.ORACLES["nexmark_q2"],
    "stream_nexmark_q5": f"SELECT starttime, itemid, num FROM ({batch.ORACLES['nexmark_q5_hour']})",
    "stream_nexmark_q7": "SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS starttime, max(value) AS best FROM events GROUP BY 1",
    "stream_nexmark_q8": batch.ORACLES["nexmark_q8"],
    "stream_median": tpcc.ORACLES["tpcc_byname_changes"],
    "stream_arrival_window": _arrival(30), "arrival_window": _arrival(30),
    "arrival_windows_concurrent": f"SELECT 'half' AS name, * FROM ({_arrival(30)}) UNION ALL SELECT 'ten', * FROM ({_arrival(600)})",
}
