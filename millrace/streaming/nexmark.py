"""The auction queries as streams: event time, watermarks, windowed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bid_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern, since the table may be one file
    return rows.select(F.col("user_id").alias("itemid"), F.col("value").alias("price"), F.col("event_id").alias("bidder_id"), F.col("ts").cast("timestamp").alias("bid_time"))


def convert(bids: DataFrame, rate: float) -> DataFrame:
    return bids.select("itemid", F.round(F.col("price") * rate, 4).alias("price"), "bidder_id")


def chosen(bids: DataFrame, items: tuple[int, ...]) -> DataFrame:
    return bids.where(F.col("itemid").isin(*items)).select("itemid", "price", "bidder_id")


def hop_counts(bids: DataFrame, size: str, slide: str, late: str = "1 hour") -> DataFrame:
    counts = bids.withWatermark("bid_time", late).groupBy(F.window("bid_time", size, slide).alias("w"), "itemid").count()
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("starttime"), "itemid", F.col("count").alias("num"))


def highest(bids: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    best = bids.withWatermark("bid_time", late).groupBy(F.window("bid_time", size).alias("w")).agg(F.max("price").alias("best"))
    return best.select(F.col("w.start").cast("timestamp_ntz").alias("starttime"), "best")


def new_sellers(people: DataFrame, auctions: DataFrame, hours: int = 12, late: str = "1 day") -> DataFrame:
    """Stream-stream join on an interval: persons (id, name, joined) and auctions (seller_id, auction_id, opened)."""
    p, a = people.withWatermark("joined", late), auctions.withWatermark("opened", late)
    near = F.expr(f"seller_id = id AND opened BETWEEN joined - INTERVAL {hours} HOURS AND joined + INTERVAL {hours} HOURS")
    return p.join(a, near).select("id", "name", "auction_id")
