"""Vector sums and matrix products as relations.

A matrix is rows (i, row array), columns (j, col array) or cells (i, j, x); a vector is places (pos, x).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, total


def vector_sum(vector: DataFrame, value: str = "x") -> DataFrame:
    """One row, total; null for no rows."""
    return vector.agg(F.sum(F.col(value).cast("double")).alias("total"))


def chunked_sum(vector: DataFrame, size: int, tail: str = "keep", pos: str = "pos", value: str = "x") -> DataFrame:
    """Sum by chunks of consecutive places, then over chunks. tail = "drop" leaves out a last partial chunk; "keep" and
    "pad" (with zeros) give the same sum."""
    chunks = vector.groupBy(F.floor(F.col(pos) / size).alias("chunk")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))
    if tail == "drop":
        chunks = chunks.where(F.col("n") == size)
    return chunks.agg(F.sum("s").alias("total"))


def batched_sum(chunks: DataFrame, values: str = "chunk") -> DataFrame:
    """Sum of rows that hold an array each."""
    return chunks.agg(F.sum(total(F.col(values))).alias("total"))


def flattened_sum(chunks: DataFrame, values: str = "chunk") -> DataFrame:
    return vector_sum(chunks.select(F.explode(values).alias("x")))


def elementwise_sum(rows: DataFrame, values: str = "row") -> DataFrame:
    """(pos, total): arrays added place by place."""
    return rows.select(F.posexplode(values).alias("pos", "x")).groupBy(F.col("pos").cast("long").alias("pos")).agg(F.sum(F.col("x").cast("double")).alias("total"))


def cells(rows: DataFrame, i: str = "i", values: str = "row") -> DataFrame:
    return rows.select(F.col(i).alias("i"), F.posexplode(values).alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("x"))


def transposed(matrix: DataFrame) -> DataFrame:
    """Of cells."""
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")


def columns(matrix: DataFrame) -> DataFrame:
    """(j, col) of cells; a column is gathered in the order of i."""
    entries = F.sort_array(F.collect_list(F.struct("i", "x")))
    return matrix.groupBy("j").agg(F.transform(entries, lambda e: e["x"]).alias("col"))


def matvec_rows(rows: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, y), row by row. The vector is one row with an array, no longer than a matrix row: it is sent to all tasks."""
    return rows.crossJoin(F.broadcast(vector)).select("i", dot(F.col("row"), F.col("v")).alias("y"))


def matvec_columns(cols: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, y) from columns: each is scaled by its place of the vector, and the scaled columns are added."""
    scaled = cols.join(vector, cols.j == vector.pos).select(F.posexplode("col").alias("i", "a"), F.col("x"))
    return scaled.groupBy(F.col("i").cast("long").alias("i")).agg(F.sum(F.col("a") * F.col("x")).alias("y"))


def matvec_cells(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, y) of cells and places: a join on j, summed by i."""
    return matrix.join(vector.select(F.col("pos").alias("j"), F.col("x").alias("v")), "j").groupBy("i").agg(F.sum(F.col("x") * F.col("v")).alias("y"))


def matvec_flat(flat: DataFrame, vector: DataFrame, width: int) -> DataFrame:
    """(i, y) of a matrix laid out flat, row after row: place p is (p // width, p % width)."""
    matrix = flat.select(F.floor(F.col("pos") / width).alias("i"), F.pmod("pos", F.lit(width)).cast("long").alias("j"), "x")
    return matvec_cells(matrix, vector)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, x) of two matrices of cells: a join on the inner index, summed by cell."""
    left = a.select("i", F.col("j").alias("k"), F.col("x").alias("a"))
    right = b.select(F.col("i").alias("k"), "j", F.col("x").alias("b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("x"))
