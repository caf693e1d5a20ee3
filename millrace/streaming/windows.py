"""Windows by arrival: what arrived at most `size` before an instant, at instants `every` apart.

The slide may be larger than the window, which event-time windows do not allow. An item of age exactly `size` is in.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instants(ts: Column, every: timedelta, size: timedelta) -> Column:
    """The evaluation instants, in microseconds since 1970, that see an item: multiples of `every` from its arrival on."""
    step, width = every // timedelta(microseconds=1), size // timedelta(microseconds=1)
    at = F.unix_micros(ts.cast("timestamp"))
    first, last = F.ceil(at / step).cast("long") * step, F.floor((at + width) / step).cast("long") * step
    none = F.array().cast("array<bigint>")
    return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(none)


def arrival_window(items: DataFrame, ts: str, value: str, every: timedelta, size: timedelta) -> DataFrame:
    """(instant, n, total) of the items in each window; instants that see nothing are left out."""
    seen = items.select(F.explode(instants(F.col(ts), every, size)).alias("us"), F.col(value).alias("x"))
    sums = seen.groupBy("us").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(18,2)")).cast("double").alias("total"))
    return sums.select(F.timestamp_micros("us").cast("timestamp_ntz").alias("instant"), "n", "total")


def live_arrival_window(items: DataFrame, ts: str, value: str, every: timedelta, size: timedelta, late: str = "1 hour") -> DataFrame:
    """arrival_window() of a stream. Instants are the event time: sums are kept for each instant, put out as they change
    (update mode), and evicted in the batch after the watermark has passed the instant."""
    seen = items.select(F.explode(instants(F.col(ts), every, size)).alias("us"), F.col(value).alias("x")).select(F.timestamp_micros("us").alias("instant"), "x")
    sums = seen.withWatermark("instant", late).groupBy("instant").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(18,2)")).cast("double").alias("total"))
    return sums.select(F.col("instant").cast("timestamp_ntz").alias("instant"), "n", "total")


def concurrent_windows(items: DataFrame, ts: str, value: str, windows: dict[str, tuple[timedelta, timedelta]]) -> DataFrame:
    """Several windows (name: every, size) over one pass of the items."""
    each = F.array(*(F.struct(F.lit(name).alias("name"), instants(F.col(ts), every, size).alias("at")) for name, (every, size) in windows.items()))
    seen = items.select(F.explode(each).alias("w"), F.col(value).alias("x")).select("w.name", F.explode("w.at").alias("us"), "x")
    sums = seen.groupBy("name", "us").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(18,2)")).cast("double").alias("total"))
    return sums.select("name", F.timestamp_micros("us").cast("timestamp_ntz").alias("instant"), "n", "total")
