"""Arithmetic on ``array<float>`` / ``array<double>`` columns, in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l2_norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def l2_normalize(vec: Column) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    scaled = F.transform(F.array(l2_norm(vec)), lambda n: F.transform(as_double(vec), lambda x: x / n))[0]
    return F.when(l2_norm(vec) > 0, scaled).otherwise(as_double(vec))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
