"""Dense-vector expressions over ARRAY<FLOAT|DOUBLE> columns (higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col_


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two equal-length arrays, accumulated in DOUBLE."""
    prods = F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def l2norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col_(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(a: str | Column) -> Column:
    """Unit-length copy of the vector; a zero vector stays zero.

    The squared norm is folded once and handed to the ``finish`` lambda, so each
    element is divided by a bound value (O(d) per row, not O(d^2)).
    """
    v = col_(a)
    return F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda ss: F.transform(v, lambda x: F.when(ss > 0, x.cast("double") / F.sqrt(ss)).otherwise(F.lit(0.0))),
    )
