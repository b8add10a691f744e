"""Structured filters (F1-F4, F19): a dict of conditions -> one Column predicate.

Conditions are ``{column: value}`` (equality) or ``{column: {"gt"|"lt"|"eq": v, ...}}``;
everything is AND-ed (the service's SQL path), so ``{"gt": a, "lt": b}`` is a
range. Values become literals in a Column expression (never pasted into SQL
text), so Parquet predicate pushdown applies to plain comparisons. Tables of cases: ``case_filters``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import all_of

_OPS = {"gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "eq": lambda c, v: c == v}


def condition(conditions: dict[str, Any] | None, columns: list[str], on_unknown: str = "error") -> Column:
    """the AND of all conditions.

    Unknown columns: ``error`` raises, ``ignore`` skips the condition (API path),
    ``empty`` selects nothing (the query path answered an empty frame).
    """
    preds: list[Column] = []
    for key, value in (conditions or {}).items():
        if key not in columns:
            if on_unknown == "ignore":
                continue
            if on_unknown == "empty":
                return F.lit(False)
            raise KeyError(f"unknown column {key!r}")
        c = F.col(key)
        if isinstance(value, dict):
            for op, v in value.items():
                if op not in _OPS:
                    raise ValueError(f"unknown operator {op!r} (use gt, lt, eq)")
                preds.append(_OPS[op](c, F.lit(v)))
        else:
            preds.append(c == F.lit(value))
    return all_of(preds)


def filter_bookings(df: DataFrame, conditions: dict[str, Any] | None, on_unknown: str = "error") -> DataFrame:
    """Rows meeting every condition (no conditions -> all rows)."""
    return df.where(condition(conditions, df.columns, on_unknown))
