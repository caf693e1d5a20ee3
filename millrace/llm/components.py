"""Connected components of a table of links, by alternating large and small stars.

Each round replaces every node's links by links to its smallest neighbour; a few rounds (logarithmic in the longest
path) leave one star a component. Rows are links, never groups; minima are pre-aggregated before the shuffle, and the
joins read exchanged tables on both sides, so that Spark can split a node that most links lead to. A round is cut into
one task for LINKS links, not into as many as there are shuffle partitions: few links would be mostly files. Its result
is read back from Parquet: a checkpoint keeps the constraints (u < v) that the planner inferred, and those would multiply
from round to round until planning takes the driver's time and memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freed, kept, written

LINKS = 20_000


def _star(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """links: node > low, distinct. Large: every larger neighbour of a node points to its smallest; small: every smaller one."""
    if large:
        both = kept(links.select(F.col("low").alias("u"), F.col("node").alias("v")).unionByName(links.select(F.col("node").alias("u"), F.col("low").alias("v"))).coalesce(tasks))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")).coalesce(tasks))
        moved = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("node"), F.col("m").alias("low"))
    else:
        least = kept(links.groupBy("node").agg(F.min("low").alias("m")).select(F.col("node").alias("w"), "m").coalesce(tasks))
        rest = links.join(least, F.col("node") == F.col("w")).where("low > m").select(F.col("low").alias("node"), F.col("m").alias("low"))
        moved = rest.unionByName(least.select(F.col("w").alias("node"), F.col("m").alias("low")))
    return written(moved.where("node > low").distinct().coalesce(tasks))


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches; the roots themselves are not listed.

    links has two columns of numbers; rows may repeat, go either way and lead from a node to itself. No links: no rows.
    """
    a, b = links.columns
    at = kept(links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("low")).where("node > low").distinct())
    sign = None
    while True:
        n, nodes, low, roots = at.agg(F.count("*"), F.count_distinct("node"), F.sum(F.col("low").cast("decimal(38,0)")), F.count_distinct("low")).first()
        if (n, nodes, low, roots) == sign or not n:
            break
        sign = (n, nodes, low, roots)
        tasks = n // LINKS + 1
        at = _star(_star(at, True, tasks), False, tasks)
        freed(links.sparkSession)
    return at.select("node", F.col("low").alias("root"))
