"""Dataflow operators that Spark lacks by name, over explicit keys and positions; bags unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join with unique output: both sides are made distinct first."""
    return left.distinct().join(right.distinct(), list(on))


def multiset_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on))


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left without the keys of right; repeated rows of left stay repeated."""
    return left.join(right, list(on), "left_anti")


def delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of `now` that `before` did not have; nulls equal nulls."""
    return now.exceptAll(before)


def partition(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and all others (also those where the test is null)."""
    passes = F.coalesce(test, F.lit(False))
    return df.where(passes), df.where(~passes)


def demux(df: DataFrame, outputs: dict[str, Sequence[Column]]) -> dict[str, DataFrame]:
    """Several projections of one frame."""
    return {name: df.select(*columns) for name, columns in outputs.items()}


def enumerated(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Adds dense positions from 0 in the given order.

    Ranges of the order are numbered in parallel: each partition of a range sort counts its rows, and the counts before
    it are added. No window over all rows, so no single task holds them.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parted = spread.select(F.spark_partition_id().alias("mr_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("mr_at"), "*")
    parted = parted.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else parted.persist()
    counts = parted.groupBy("mr_part").count()
    before = Window.orderBy("mr_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("mr_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("mr_start"))
    return parted.join(F.broadcast(starts), "mr_part").select((F.col("mr_start") + F.col("mr_at")).alias(name), *df.columns)


def zipped(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Pairs rows of equal position; the longer side is cut."""
    return left.join(right, pos)


def merge_sorted(left: DataFrame, right: DataFrame, order: Sequence[str]) -> DataFrame:
    """All rows of both in order; among equal rows those of the right side come first."""
    both = right.withColumn("mr_side", F.lit(0)).unionByName(left.withColumn("mr_side", F.lit(1)))
    return both.orderBy(*order, "mr_side").drop("mr_side")


def reduce_by_key(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """fold_keyed and reduce_keyed: partial aggregates before the shuffle, final ones after it."""
    return df.groupBy(*keys).agg(*(c.alias(name) for name, c in aggregates.items()))


def collected(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "values") -> DataFrame:
    """A group's values as an array in a defined order (never that of arrival)."""
    entries = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("mr_value"))))
    return df.groupBy(*keys).agg(F.transform(entries, lambda e: e["mr_value"]).alias(name))


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """A tap: metrics are gathered while the rows pass."""
    return df.observe(name, *(c.alias(k) for k, c in metrics.items()))


def asserted(df: DataFrame, test: Column, message: str) -> DataFrame:
    """Fails when a row does not pass."""
    return df.where(F.assert_true(test, message).isNull())


def routed(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Rows dealt to partitions by a hash of their keys."""
    return df.repartition(partitions, *keys)
