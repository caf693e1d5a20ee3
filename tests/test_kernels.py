"""Golden values of the kernels, and equalities between their variants."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.vectors import distance, fixed, to_chunks
from millrace.operators import kmeans as K
from millrace.operators import linalg as L
from millrace.operators import median as M
from millrace.operators import relational as R


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


@pytest.mark.parametrize("a, b, d", [((1, 2, 3), (4, 5, 6), 5.196152422706632), ((0, 0), (3, 4), 5), ((0, 0), (-3, -4), 5)])
def test_distance(spark, a, b, d):
    assert one(spark, distance(vec(*a), vec(*b))) == pytest.approx(d)


def test_chunks(spark):
    assert one(spark, to_chunks(vec(1, 2, 3, 4, 5), 2, "pad")) == [[1, 2], [3, 4], [5, 0]]
    assert one(spark, to_chunks(vec(1, 2, 3, 4, 5), 2)) == [[1, 2], [3, 4], [5]]
    assert one(spark, to_chunks(vec(1, 2, 3, 4, 5), 2, "drop")) == [[1, 2], [3, 4]]
    assert one(spark, to_chunks(F.array().cast("array<double>"), 2)) == []
    assert one(spark, fixed(vec(1, 2), 3)) == [1, 2, 0]


def vector(spark, xs):
    return spark.createDataFrame(list(enumerate(map(float, xs))), "pos long, x double")


def test_vector_sums(spark):
    five = vector(spark, [1, 2, 3, 4, 5])
    assert L.vector_sum(five).first().total == 15
    assert [L.chunked_sum(five, 2, tail).first().total for tail in ("keep", "pad", "drop")] == [15, 15, 10]
    pairs = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],), ([5.0, 6.0],)], "chunk array<double>")
    assert L.batched_sum(pairs).first().total == L.flattened_sum(pairs).first().total == 21
    assert L.vector_sum(five.where("false")).first().total is None


def test_matrix_products(spark):
    rows = spark.createDataFrame([(i, [3.0 * i + 1, 3.0 * i + 2, 3.0 * i + 3]) for i in range(3)], "i long, row array<double>")
    v = vector(spark, [1, 2, 3])
    want = {0: 14, 1: 32, 2: 50}
    cells = L.cells(rows)
    got = lambda df: {r.i: r.y for r in df.collect()}
    assert got(L.matvec_rows(rows, spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>"))) == want
    assert got(L.matvec_columns(L.columns(cells), v)) == want
    assert got(L.matvec_cells(cells, v)) == want
    assert got(L.matvec_flat(cells.select((F.col("i") * 3 + F.col("j")).alias("pos"), "x"), v, 3)) == want
    ones = lambda n, m: spark.createDataFrame([(i, j, 1.0) for i in range(n) for j in range(m)], "i long, j long, x double")
    assert sorted(map(tuple, L.matmul(ones(3, 2), ones(2, 1)).collect())) == [(0, 0, 2.0), (1, 0, 2.0), (2, 0, 2.0)]


def points(spark, *xs):
    return spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(xs)], "id long, coordinates array<double>")


def test_kmeans(spark):
    three = points(spark, (1, 2), (3, 4), (5, 6))
    labels = lambda df: [r.label for r in df.orderBy("id").collect()]
    assert labels(K.assign(three, [[1, 2], [4, 5]])) == [0, 1, 1]
    assert K.update(three, [[1.0, 2.0], [4.0, 5.0]]) == [[1, 2], [4, 5]]
    assert K.converged([[1, 2]], [[1, 2]], 0.1) and not K.converged([[1, 2]], [[3, 4]], 0.1)
    assert labels(K.kmeans(three, 2)) == [0, 1, 1]
    assert labels(K.kmeans(points(spark, (1, 2), (3, 4), (5, 6), (7, 8), (9, 10)), 2)) == [0, 0, 1, 1, 1]
    assert K.update(three, [[1.0, 2.0], [99.0, 99.0]])[1] == [99, 99]  # a centroid without points stays


def test_generated_medians(spark):
    g = M.generated(spark, 10, 3, 2)
    assert sorted(r.c_id for r in g["deletes"].collect()) == [3, 4]
    for median in (M.median_by_array, M.median_by_rank):
        assert median(g["base"], g["parameters"]).first().c_id == 5
        assert median(g["base"].unionByName(g["inserts"]), g["parameters"]).first().c_id == 3
        assert median(M.after_changes(g["base"], g["inserts"], g["deletes"]), g["parameters"]).first().c_id == 2


def test_merge_and_positions(spark):
    odd, even = (spark.createDataFrame([(x,) for x in xs], "k long") for xs in ([1, 3, 5, 7, 9], [2, 4, 6, 8, 10]))
    assert [r.k for r in R.merge_sorted(odd, even, ["k"]).collect()] == list(range(1, 11))
    numbered = R.enumerated(odd.unionByName(even), ["k"])
    assert sorted(map(tuple, numbered.collect())) == [(k - 1, k) for k in range(1, 11)]
    yes, no = R.partition(spark.createDataFrame([(1,), (None,)], "k long"), F.col("k") > 0)
    assert yes.count() == no.count() == 1
    with pytest.raises(Exception, match="positive"):
        R.asserted(odd, F.col("k") > 1, "positive").collect()
