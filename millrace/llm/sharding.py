"""Sharding by sampled splitters; DataFrame operations only.

Records are ordered by a key, here a hash of the text, then the id, then a number of the row, so that equal texts lie
together and no two records are equal. A sample of keys, drawn with a chance in proportion to a record's size, gives
quantile boundaries: ranges of about equal bytes. The ranges are measured exactly. Overfull ones, and those that the end
of a shard would fall into by more than NEAR of a shard, are subdivided by a denser sample of their own, until none is
left or they hold one record. A shard is a run of ranges: between which boundaries a record lies decides where it goes.
A group of equal texts, repeated rows too, is split between ranges like any others. Shard sizes differ by twice NEAR of
a shard or one record.

Law `bytes`. A null text has no bytes. A null id is smaller than any other. An empty table gives no rows. Only ids,
sizes and hashes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import kept

#: Ranges to a shard at least, rows to a range at most (on average), sampled keys to a range, parts that a range is
#: subdivided into, and the share of a shard that may lie on the wrong side of its end.
RANGES, RANGE_ROWS, SAMPLES, PARTS, NEAR = 24, 500_000, 16, 64, 0.001
_ORDER = ("key", "id", "tie")


def _slot(bits: int) -> Column:
    """A key's leading bits choose the few splitters that it is compared with."""
    return F.shiftright("key", 64 - bits)


def _splitters(rows: DataFrame, step: Column, bits: int) -> DataFrame:
    """Boundaries such that about `step` bytes lie between two of them, from a size-weighted sample of rows.

    A row is drawn for every step / SAMPLES bytes of its own, the rest by chance (a hash of the row, so that a lost task
    draws the same again); every SAMPLES-th drawn key of each slot is a boundary.
    """
    share = F.col("weight") * SAMPLES / step
    luck = F.pmod(F.xxhash64(*_ORDER, F.lit(6)), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.select(*_ORDER, (F.floor(share) + (luck < share - F.floor(share)).cast("long")).alias("draws")).where("draws > 0")
    place = Window.partitionBy(_slot(bits)).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("upto", F.sum("draws").over(place))
    return drawn.where(F.floor(F.col("upto") / SAMPLES) > F.floor((F.col("upto") - F.col("draws")) / SAMPLES)).select(*_ORDER)


def _ranged(rows: DataFrame, splitters: DataFrame, bits: int) -> DataFrame:
    """rows with part: the slot, and piece: the number of boundaries of it that are not above the row.

    There are about as many boundaries as ranges, one for each RANGE_ROWS rows at most: they are few, and broadcast.
    """
    bounds = splitters.groupBy(_slot(bits).alias("slot")).agg(F.sort_array(F.collect_list(F.struct(*_ORDER))).alias("bounds"))
    own = F.struct(*_ORDER)
    out = rows.join(F.broadcast(bounds), _slot(bits) == F.col("slot"), "left")
    below = F.when(F.col("bounds").isNull(), 0).otherwise(F.size(F.filter("bounds", lambda b: b <= own)))
    return out.select(*rows.columns, _slot(bits).alias("part"), below.alias("piece"))


def _ranges(ranged: DataFrame) -> DataFrame:
    """part, piece, bytes, rows, largest (record), end (bytes up to here) and row0 (rows before) of each range."""
    sums = ranged.groupBy("part", "piece").agg(F.sum("weight").alias("bytes"), F.count("*").alias("rows"), F.max("weight").alias("largest"))
    upto = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, 0)
    # one row a range: a bounded table
    return kept(sums.select("*", F.sum("bytes").over(upto).alias("end"), (F.sum("rows").over(upto) - F.col("rows")).alias("row0")))


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (null)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"))
    rows = kept(rows.select("*", F.greatest("size", F.lit(1)).alias("weight"), F.monotonically_increasing_id().alias("tie")))
    total, n = rows.agg(F.coalesce(F.sum("weight"), F.lit(1)), F.count("*")).first()
    ranges = max(shards * RANGES, n // RANGE_ROWS)
    shard, step, bits = total / shards, max(1.0, total / ranges), max(6, (ranges // 16).bit_length())
    middle = F.col("end") - F.col("bytes") / 2
    # how much of a range lies on the smaller side of the shard's end that is nearest to its middle
    nearest = F.round(middle / shard)
    cut = F.when(nearest.between(1, shards - 1), F.col("bytes") / 2 - F.abs(middle - nearest * shard)).otherwise(0)
    overfull = (F.col("rows") > 1) & ((F.col("bytes") - F.col("largest") > 4 * step) | (F.col("rows") > 4 * RANGE_ROWS) | (cut > NEAR * shard))
    splitters = kept(_splitters(rows, F.lit(step), bits))
    while True:  # ends: each round leaves an overfull range its largest record and about a PARTS-th of the rest
        ranged = _ranged(rows, splitters, bits)
        found = _ranges(ranged)
        again = kept(found.where(overfull).select("part", "piece", ((F.col("bytes") - F.col("largest")) / PARTS).alias("step")))
        if again.isEmpty():
            break
        inside = ranged.join(F.broadcast(again), ["part", "piece"])
        splitters = kept(splitters.unionByName(_splitters(inside, F.col("step"), bits)).distinct())
    found = found.select("part", "piece", "row0", F.least(F.floor(middle / shard), F.lit(shards - 1)).cast("int").alias("shard"))
    starts = found.select("*", F.min("row0").over(Window.partitionBy("shard")).alias("first"))
    inside = Window.partitionBy("part", "piece").orderBy(*_ORDER)
    placed = ranged.select("*", (F.row_number().over(inside) - 1).alias("row1")).join(F.broadcast(starts), ["part", "piece"])
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("row0") + F.col("row1") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
