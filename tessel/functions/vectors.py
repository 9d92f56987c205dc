"""Vector expressions: distances, similarity, normalisation, fitting to a dimension, parsing.

All are built-in higher-order functions evaluated in double precision, so they stay in the JVM. l2 is the squared Euclidean
distance; ip and cosine are similarities, larger being nearer.
"""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EmptyVector, UnsupportedMetric

METRICS = ("l2", "ip", "cosine")


def doubles(v: Column | Sequence[float]) -> Column:
    """A vector column or literal as array<double>; literals pass through float32 as stored vectors do."""
    if isinstance(v, Column):
        return v.cast("array<double>")
    if not len(v):
        raise EmptyVector("a query vector has no components")
    return F.array(*(F.lit(float(x)) for x in v)).cast("array<float>").cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def measure(metric: str, vector: Column, query: Column | Sequence[float]) -> Column:
    a, b = doubles(vector), doubles(query)
    if metric == "l2":
        return squared_distance(a, b)
    if metric == "ip":
        return dot(a, b)
    if metric == "cosine":
        return cosine(a, b)
    raise UnsupportedMetric(f"{metric}: use one of {', '.join(METRICS)}")


def nearest_first(metric: str, column: str = "distance") -> Column:
    """Sort order of a measure."""
    return F.col(column).asc() if metric == "l2" else F.col(column).desc()


def normalized(v: Column) -> Column:
    """Scaled to length 1; a vector of zeros stays."""
    a = doubles(v)
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


def fitted(v: Column, dim: int, pad: float = 0.0) -> Column:
    """Exactly dim components: cut at the end, or padded there."""
    return F.slice(F.concat(doubles(v), F.array_repeat(F.lit(float(pad)), dim)), 1, dim)


def parsed(text: Column) -> Column:
    """Vectors written as "0.1,0.2" or "[0.1, 0.2]"."""
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    return F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("float"))
