"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.lexis import bind


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda total, x: total + x * x))


def unit(vec: Column) -> Column:
    """Vector of length one; a zero vector stays as it is."""
    return bind(
        norm(vec),
        lambda length: F.when(length > 0, F.transform(vec, lambda x: x / length)).otherwise(
            vec
        ),
    )
