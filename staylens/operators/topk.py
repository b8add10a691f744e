"""Sort / limit / top-k operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """First ``k`` rows by ``order`` (ties must be broken inside ``order``).

    Without groups this is ``orderBy().limit()`` -> TakeOrderedAndProject (each
    task keeps k rows). With groups it is ``row_number() <= k`` over a window,
    which Spark plans with a WindowGroupLimit before the shuffle.
    """
    by = list(by or [])
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def frequency_top_k(df: DataFrame, key: str, k: int = 10, by: list[str] | None = None, name: str = "n") -> DataFrame:
    """L1: value counts of ``key`` (NULL keys dropped), the ``k`` largest, ties by key."""
    by = list(by or [])
    counts = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias(name))
    return top_k(counts, k, [F.col(name).desc(), F.col(key).asc()], by)


def arg_max_count(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """L3: the most frequent non-NULL ``key`` and its count (ties -> smallest key)."""
    by = list(by or [])
    counts = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    # the largest count with the smallest key is the minimum of (-n, key)
    agg = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col(key).alias("k"))).alias("_m"))
    return agg.select(*by, F.col("_m.k").alias(key), (-F.col("_m.neg_n")).alias("n"))


def recent(df: DataFrame, n: int, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """Newest ``n`` rows (``ORDER BY ts DESC, id DESC LIMIT n``)."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(tie).desc()).limit(n)
