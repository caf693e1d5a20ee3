"""Customer by name: the median customer, in batch and after changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import median as M
from ..sources.tables import table


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied customers as the workload's: warehouse = nation, district = nation modulo 10, last name = segment."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c_id"), (F.col("c_nationkey") % 10).alias("c_d_id"), F.col("c_nationkey").alias("c_w_id"), F.col("c_name").alias("c_first"), F.col("c_mktsegment").alias("c_last"))


def byname_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = customers(spark, sf_dir)
    return M.median_by_array(people, people)


def byname_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = customers(spark, sf_dir)
    return M.median_by_rank(people, people)


def byname_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base: ids not divisible by 3; inserted: the others; deleted: ids divisible by 5."""
    people = customers(spark, sf_dir)
    now = M.after_changes(people.where("c_id % 3 != 0"), people.where("c_id % 3 = 0"), people.where("c_id % 5 = 0"))
    return M.median_by_rank(now, people)


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated workload (10, 3, 2): the medians of its three states."""
    g = M.generated(spark, 10, 3, 2)
    states = {"base": g["base"], "inserts": g["base"].unionByName(g["inserts"]), "changes": M.after_changes(g["base"], g["inserts"], g["deletes"])}
    rows = [M.median_by_array(df, g["parameters"]).select(F.lit(name).alias("state"), "c_id", "c_first") for name, df in states.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_ALL = "c AS (SELECT c_custkey AS c_id, c_nationkey % 10 AS c_d_id, c_nationkey AS c_w_id, c_name AS c_first, c_mktsegment AS c_last FROM customer)"
_MEDIAN = """SELECT c_w_id, c_d_id, c_last, c_first, c_id FROM now QUALIFY row_number() OVER (PARTITION BY c_w_id, c_d_id, c_last ORDER BY c_first, c_id) = count(*) OVER (PARTITION BY c_w_id, c_d_id, c_last) // 2 + 1"""
QUERIES = {"tpcc_byname_array": byname_array, "tpcc_byname_rank": byname_rank, "tpcc_byname_changes": byname_changes, "tpcc_generated": generated}
ORACLES = {
    "tpcc_byname_array": f"WITH {_ALL}, now AS (FROM c) {_MEDIAN}",
    "tpcc_byname_rank": f"WITH {_ALL}, now AS (FROM c) {_MEDIAN}",
    "tpcc_byname_changes": f"WITH {_ALL}, now AS (FROM c WHERE c_id % 5 != 0) {_MEDIAN}",
    "tpcc_generated": "SELECT * FROM (VALUES ('base', CAST(5 AS BIGINT), '5'), ('inserts', 3, '3'), ('changes', 2, '2')) t(state, c_id, c_first)",
}
