"""Column functions over arrays of numbers; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_zero = lambda: F.lit(0.0)


def total(values: Column) -> Column:
    """Sum of an array in double precision; an empty array gives 0."""
    return F.aggregate(values, _zero(), lambda a, x: a + x.cast("double"))


def _pairs(a: Column, b: Column, f) -> Column:
    """f over places that both arrays have: the longer one is cut."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return total(_pairs(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column) -> Column:
    """Euclidean."""
    return F.sqrt(total(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def to_chunks(values: Column, size: int, tail: str = "keep") -> Column:
    """An array in chunks. tail: keep the last partial chunk, pad it with zeros, or drop it."""
    n = F.size(values)
    count = F.floor(n / size) if tail == "drop" else F.ceil(n / size)
    whole = F.concat(values.cast("array<double>"), F.array_repeat(_zero(), size)) if tail == "pad" else values.cast("array<double>")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(whole, (i * size + 1).cast("int"), F.lit(size)))
    return F.when(count > 0, chunks).otherwise(F.array().cast("array<array<double>>"))


def fixed(values: Column, size: int) -> Column:
    """An array of exactly `size` numbers: cut, or padded with zeros."""
    return F.slice(F.concat(values.cast("array<double>"), F.array_repeat(_zero(), size)), 1, size)
