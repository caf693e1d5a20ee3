"""Readers of the supplied Parquet tables, and columns that queries need but the tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A table, narrowed to `columns`; with `limit`, its first rows by those columns, so that a limit is repeatable."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return df if limit is None else df.orderBy(*df.columns).limit(limit)


def lineitem_dates(lineitem: DataFrame) -> DataFrame:
    """Adds l_commitdate and l_receiptdate, derived from the ship date and the keys."""
    ship = F.to_date("l_shipdate")
    return lineitem.withColumn("l_commitdate", F.date_add(ship, ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 61 - 30).cast("int"))).withColumn(
        "l_receiptdate", F.date_add(ship, (1 + (F.col("l_orderkey") * 11 + F.col("l_linenumber") * 3) % 30).cast("int"))
    )


def lineitem_shipping(lineitem: DataFrame) -> DataFrame:
    """Adds l_shipmode and l_shipinstruct, dealt by the keys."""
    mode = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    return lineitem.withColumn("l_shipmode", F.when(mode == 0, "AIR").when(mode == 1, "AIR REG").when(mode == 2, "RAIL").otherwise("SHIP")).withColumn(
        "l_shipinstruct", F.when((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 2 == 0, "DELIVER IN PERSON").otherwise("NONE")
    )


def part_container(part: DataFrame) -> DataFrame:
    """Adds p_container, dealt by the key."""
    kind = F.col("p_partkey") % 4
    return part.withColumn("p_container", F.when(kind == 0, "SM BOX").when(kind == 1, "MED BOX").when(kind == 2, "LG BOX").otherwise("JUMBO JAR"))
