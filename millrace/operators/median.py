"""The median customer of a name: customers of a district and a last name in order of first name, the upper middle one.

Ties of first names go by id. Districts are whole keys: a warehouse, a district and an id name a customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["c_w_id", "c_d_id", "c_last"]


def generated(spark: SparkSession, base: int, update: int, delete: int) -> dict[str, DataFrame]:
    """base, inserts, deletes and parameters as the workload defines them: ids below base, the next ids, and `delete`
    ids from the middle of the base, which counts down."""
    person = lambda ids: ids.select(
        F.col("id").alias("c_id"), F.lit(43).alias("c_d_id"), F.lit(44).alias("c_w_id"), F.col("id").cast("string").alias("c_first"), F.lit("").alias("c_middle"), F.lit("lastname").alias("c_last"),
        *(F.lit(None).cast(t).alias(f"c_{n}") for n, t in (("street_1", "string"), ("street_2", "string"), ("city", "string"), ("state", "string"), ("zip", "string"), ("phone", "string"), ("since", "date"), ("credit", "string"), ("credit_lim", "double"), ("discount", "double"), ("balance", "double"))),
    )
    last = base - base // 2
    return {
        "base": person(spark.range(base)), "inserts": person(spark.range(base, base + update)), "deletes": person(spark.range(max(0, last - delete), last)),
        "parameters": spark.range(1).select(F.lit(1).alias("txn_id"), F.lit(44).alias("c_w_id"), F.lit(43).alias("c_d_id"), F.lit("lastname").alias("c_last")),
    }


def median_by_array(customers: DataFrame, parameters: DataFrame) -> DataFrame:
    """As an ordered array for each group and its middle entry."""
    asked = customers.join(parameters.select(*KEYS).distinct(), KEYS, "left_semi")
    arrays = asked.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("c_first", "c_id"))).alias("a"))
    return arrays.select(*KEYS, F.get("a", F.floor(F.size("a") / 2).cast("int")).alias("m")).select(*KEYS, "m.c_first", "m.c_id")


def median_by_rank(customers: DataFrame, parameters: DataFrame) -> DataFrame:
    """As ranks within groups; no group becomes one value."""
    asked = customers.join(parameters.select(*KEYS).distinct(), KEYS, "left_semi")
    group = Window.partitionBy(*KEYS)
    ranked = asked.select(*KEYS, "c_first", "c_id", F.row_number().over(group.orderBy("c_first", "c_id")).alias("rank"), F.count("*").over(group).alias("n"))
    return ranked.where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select(*KEYS, "c_first", "c_id")


def after_changes(base: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """base with inserts, without the deleted customers."""
    return base.unionByName(inserts).join(deletes.select("c_w_id", "c_d_id", "c_id"), ["c_w_id", "c_d_id", "c_id"], "left_anti")
