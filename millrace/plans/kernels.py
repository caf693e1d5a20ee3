"""Vector, matrix and clustering queries over the supplied embeddings."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import distance, to_chunks
from ..operators import kmeans as K
from ..operators import linalg as L
from ..sources.tables import table

WIDTH = 64


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix: i, row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("row"))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, x: the matrix laid out row after row."""
    cells = L.cells(rows(spark, sf_dir))
    return cells.select((F.col("i") * WIDTH + F.col("j")).alias("pos"), "x")


def _vector(spark: SparkSession) -> DataFrame:
    """pos, x: WIDTH places of small numbers."""
    return spark.range(WIDTH).select(F.col("id").alias("pos"), (F.col("id") % 7 - 3).cast("double").alias("x"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


def vector_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(L.vector_sum(_flat(spark, sf_dir)), "total")


def chunked_sum(spark: SparkSession, sf_dir: str, size: int, tail: str) -> DataFrame:
    return _rounded(L.chunked_sum(_flat(spark, sf_dir), size, tail), "total")


def batched_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(L.batched_sum(rows(spark, sf_dir), "row"), "total")


def flattened_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(L.flattened_sum(rows(spark, sf_dir), "row"), "total")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row in chunks of ten, the last padded with zeros; the chunks' sums."""
    split = rows(spark, sf_dir).select("i", F.posexplode(to_chunks(F.col("row"), 10, "pad")).alias("chunk", "values"))
    return split.select("i", F.col("chunk").cast("long").alias("chunk"), F.size("values").cast("long").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


def elementwise_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(L.elementwise_sum(rows(spark, sf_dir)), "total")


def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.transposed(L.cells(rows(spark, sf_dir)))


def matvec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = _vector(spark).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("v"))
    return _rounded(L.matvec_rows(rows(spark, sf_dir), vector), "y")


def matvec_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(L.matvec_columns(L.columns(L.cells(rows(spark, sf_dir))), _vector(spark)), "y")


def matvec_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(L.matvec_cells(L.cells(rows(spark, sf_dir)), _vector(spark)), "y")


def matvec_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(L.matvec_flat(_flat(spark, sf_dir), _vector(spark), WIDTH), "y")


def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' Gram matrix: transpose times matrix."""
    cells = L.cells(rows(spark, sf_dir))
    return _rounded(L.matmul(L.transposed(cells), cells), "x")


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector to vector 0."""
    all_rows = rows(spark, sf_dir)
    first = all_rows.where("i = 0").select(F.col("row").alias("first"))
    return all_rows.crossJoin(F.broadcast(first)).select("i", F.round(distance(F.col("row"), F.col("first")), 6).alias("d"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select(F.col("i").alias("id"), F.col("row").alias("coordinates"))


def kmeans_assign(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """One assignment to the first k points."""
    seeds = [list(r.coordinates) for r in points(spark, sf_dir).orderBy("id").limit(k).collect()]
    return K.assign(points(spark, sf_dir), seeds).select("id", F.col("label").cast("long").alias("label"))


def kmeans_update(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The centroids after one round."""
    labels = kmeans_assign(spark, sf_dir, k)
    told = points(spark, sf_dir).join(labels, "id").select("label", F.posexplode("coordinates").alias("pos", "x"))
    return told.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg("x"), 6).alias("mean"))


def kmeans_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kmeans(points(spark, sf_dir), 5, max_iterations=20).select("id", F.col("label").cast("long").alias("label"))


def uniform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 points of two coordinates between -1 and 1; a hash of the id and a seed is the draw, so partitions change nothing."""
    draw = lambda seed: F.conv(F.substring(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 31)) - 1
    return spark.range(1000).select("id", draw("42").alias("x"), draw("43").alias("y"))


QUERIES = {
    "kernel_vector_sum": vector_sum, "kernel_chunked_sum_keep": partial(chunked_sum, size=10, tail="keep"), "kernel_chunked_sum_drop": partial(chunked_sum, size=7, tail="drop"), "kernel_chunked_sum_pad": partial(chunked_sum, size=7, tail="pad"),
    "kernel_batched_sum": batched_sum, "kernel_flattened_sum": flattened_sum, "kernel_chunks": chunks, "kernel_elementwise_sum": elementwise_sum, "kernel_transpose": transpose, "kernel_matvec_rows": matvec_rows,
    "kernel_matvec_columns": matvec_columns, "kernel_matvec_cells": matvec_cells, "kernel_matvec_flat": matvec_flat, "kernel_matmul": matmul, "kernel_distances": distances, "kernel_kmeans_assign": kmeans_assign,
    "kernel_kmeans_update": kmeans_update, "kernel_kmeans": kmeans_loop, "kernel_uniform_points": uniform_points,
}
_CELLS = "cells AS (SELECT vec_id AS i, j, CAST(embedding[j + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(j))"
_SUM = f"WITH {_CELLS} SELECT round(sum(x), 6) AS total FROM cells"
_MATVEC = f"WITH {_CELLS} SELECT i, round(sum(x * (j % 7 - 3)), 6) AS y FROM cells GROUP BY i"
_ASSIGN = f"""{_CELLS}, d AS (SELECT a.i AS id, b.i AS label, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM cells a JOIN cells b ON a.j = b.j AND b.i < 5 GROUP BY ALL),
labels AS (SELECT id, label FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, label) = 1)"""
def _kmeans_sql(rounds: int, k: int = 5) -> str:
    """The loop unrolled: each round labels the points and moves the centroids; one that lost its points stays."""
    steps = [f"WITH {_CELLS}, c0 AS (SELECT i AS label, j, x FROM cells WHERE i < {k})"]
    for r in range(rounds):
        steps.append(f"d{r} AS (SELECT p.i AS id, c.label, sqrt(sum((p.x - c.x) * (p.x - c.x))) AS d FROM cells p JOIN c{r} c ON p.j = c.j GROUP BY ALL)")
        steps.append(f"l{r} AS MATERIALIZED (SELECT id, label FROM d{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, label) = 1)")
        steps.append(f"m{r} AS (SELECT label, j, avg(x) AS x FROM l{r} JOIN cells ON id = i GROUP BY ALL)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.label, o.j, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m ON o.label = m.label AND o.j = m.j)")
    return ",\n".join(steps) + f"\nSELECT id, label FROM l{rounds - 1}"


_DRAW = "CAST(CAST('0x' || substr(md5(id || '-{seed}'), 1, 8) AS BIGINT) AS DOUBLE) / 2147483648.0 - 1"
ORACLES = {
    "kernel_kmeans": _kmeans_sql(20),
    "kernel_uniform_points": f"SELECT id, {_DRAW.format(seed=42)} AS x, {_DRAW.format(seed=43)} AS y FROM range(1000) r(id)",
    "kernel_vector_sum": _SUM, "kernel_chunked_sum_keep": _SUM, "kernel_chunked_sum_pad": _SUM, "kernel_batched_sum": _SUM, "kernel_flattened_sum": _SUM,
    "kernel_chunked_sum_drop": f"WITH {_CELLS}, c AS (SELECT (i * 64 + j) // 7 AS chunk, sum(x) AS s, count(*) AS n FROM cells GROUP BY 1) SELECT round(sum(s), 6) AS total FROM c WHERE n = 7",
    "kernel_chunks": f"WITH {_CELLS} SELECT i, j // 10 AS chunk, CAST(10 AS BIGINT) AS n, round(sum(x), 6) AS s FROM cells GROUP BY 1, 2",
    "kernel_elementwise_sum": f"WITH {_CELLS} SELECT j AS pos, round(sum(x), 6) AS total FROM cells GROUP BY 1",
    "kernel_transpose": f"WITH {_CELLS} SELECT j AS i, i AS j, x FROM cells",
    "kernel_matvec_rows": _MATVEC, "kernel_matvec_columns": _MATVEC, "kernel_matvec_cells": _MATVEC, "kernel_matvec_flat": _MATVEC,
    "kernel_matmul": f"WITH {_CELLS} SELECT a.j AS i, b.j AS j, round(sum(a.x * b.x), 6) AS x FROM cells a JOIN cells b ON a.i = b.i GROUP BY 1, 2",
    "kernel_distances": f"WITH {_CELLS} SELECT a.i AS i, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS d FROM cells a JOIN cells b ON a.j = b.j AND b.i = 0 GROUP BY 1",
    "kernel_kmeans_assign": f"WITH {_ASSIGN} SELECT id, label FROM labels",
    "kernel_kmeans_update": f"WITH {_ASSIGN} SELECT label, j AS pos, round(avg(x), 6) AS mean FROM labels JOIN cells ON id = i GROUP BY 1, 2",
}
