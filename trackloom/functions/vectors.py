"""Column functions on arrays of numbers; they stay inside generated code or the JVM's array functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def centroid(a: Column | str) -> Column:
    """Mean bin of the magnitudes over the number of bins; 0.5 for silence."""
    m = F.transform(a, lambda x: F.abs(x.cast("double")))
    total = F.aggregate(m, F.lit(0.0), lambda s, v: s + v)
    return F.when(total > 0, F.aggregate(F.transform(m, lambda x, k: x * k), F.lit(0.0), lambda s, v: s + v) / total / F.size(a)).otherwise(0.5)


def decibel(x: Column, floor: float = -80.0) -> Column:
    return F.greatest(20 * F.log10(F.greatest(x, F.lit(1e-10))), F.lit(floor))


def dct_row(k: int, n: int) -> list[float]:
    """Row k of the orthonormal DCT-II."""
    scale = math.sqrt((1 if k == 0 else 2) / n)
    return [scale * math.cos(math.pi * k * (2 * i + 1) / (2 * n)) for i in range(n)]


def dct(a: Column | str, n: int, coefficients: int) -> Column:
    return F.array(*[dot(a, F.array(*map(F.lit, dct_row(k, n)))) for k in range(coefficients)])
