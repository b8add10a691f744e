"""Small Column builders shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import MONTHS


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as DOUBLE, 0 when the denominator is 0 or NULL (service guard)."""
    return F.coalesce(F.try_divide(col_(num).cast("double"), col_(den).cast("double")), F.lit(0.0))


def differs(a: str | Column, b: str | Column) -> Column:
    """Inequality where NULL != value is true and NULL != NULL is false (pandas ``!=``)."""
    return ~col_(a).eqNullSafe(col_(b))


def positive_flag(c: str | Column) -> Column:
    """``(c > 0)`` as 0/1; NULL counts as 0."""
    return F.coalesce(col_(c) > 0, F.lit(False)).cast("int")


def all_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def month_number(month_name: str | Column) -> Column:
    """1..12 for an English month name, NULL otherwise."""
    arr = F.array(*[F.lit(m) for m in MONTHS])
    pos = F.array_position(arr, col_(month_name))
    return F.when(pos > 0, pos.cast("int"))


def right_closed_bins(c: str | Column, edges: list[float], labels: list[str], open_top: bool = True) -> Column:
    """Label of the right-closed bin (edges[i], edges[i+1]] holding ``c``; NULL outside.

    With ``open_top`` the last label covers (edges[-1], +inf).
    """
    x = col_(c)
    uppers = edges[1:] + ([None] if open_top else [])
    expr = None
    for lo, hi, label in zip(edges, uppers, labels):
        cond = (x > lo) if hi is None else ((x > lo) & (x <= hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def label_order(c: str | Column, labels: list[str]) -> Column:
    """1-based position of a category label (for ordered output)."""
    return F.array_position(F.array(*[F.lit(v) for v in labels]), col_(c)).cast("int")
