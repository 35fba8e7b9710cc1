"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The norm is worked out once a row: named inside the transform it would be, in an interpreted lambda, once a component."""
    return F.element_at(F.transform(F.array(norm(v) + EPS), lambda n: F.transform(v, lambda x: x / n)), 1)


def jaccard(shared: Column, together: Column) -> Column:
    """Of counts: shared over together, 0 where nothing is together."""
    return F.when(together > 0, shared / together).otherwise(0.0)
