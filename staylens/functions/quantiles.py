"""Quantile operators.

Exact quantiles are selected by rank, nothing is sorted by ranges: a sketch of each group gives brackets that are sure to
hold the wanted ranks; one more pass counts what lies between the brackets and the values inside them, and only those
few values are put in order. ``approx_quantile`` is the sketch alone (``percentile_approx``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import all_of, col_

APPROX_ACCURACY = 100000
#: Ranks of the bracketing sketch are right to n / ACCURACY; smaller groups are counted whole.
ACCURACY = 10000
#: Cut points of weighted values.
CUTS = 64


def approx_quantile(c: str | Column, q: float) -> Column:
    """Quantile by a sketch of fixed size; NULLs ignored."""
    return F.percentile_approx(col_(c), F.lit(q), APPROX_ACCURACY).cast("double")


def select_ranks(df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], near: list[float], by: list[str] | None = None,
                 weight: str | None = None) -> DataFrame:
    """(by, _n, and per name of ``ranks`` the value of that rank): ``ranks[name](n)`` is a rank from 0 among the n non-NULL values of a
    group, NULL where there is none; every rank lies within one place of a share in ``near`` of the group. ``weight`` repeats a value.

    A value inside a bracket is counted as itself, one outside only by the bracket below it, so a group leaves the pass as its
    candidates and a row per gap. A rank that falls into a gap would mean a wrong bracket and is an error.
    """
    by = list(by or [])
    brackets = _weighted_brackets(df, value, near, by, weight) if weight else _brackets(df, value, near, by)
    given = df.where(F.col(value).isNotNull())
    if by:
        given = _join(given, brackets, by)
    else:
        one = brackets.select(F.struct("_lo", "_hi", "_n").alias("_b")).scalar()
        given = given.withColumns({c: one.getField(c) for c in ("_lo", "_hi", "_n")})
    x = F.col(value)
    inside = F.exists(F.arrays_zip("_lo", "_hi"), lambda b: (b["_lo"].isNull() | (x >= b["_lo"])) & (b["_hi"].isNull() | (x <= b["_hi"])))
    below = F.array_max(F.filter("_hi", lambda h: h < x))  # NULL: below all brackets
    counted = given.groupBy(*by, F.when(inside, x).otherwise(below).alias("_x"), (~inside).alias("_gap")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"), F.max("_n").alias("_n"))
    upto = Window.partitionBy(*by).orderBy(F.col("_x").asc_nulls_first(), "_gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = counted.withColumn("_cum", F.sum("_c").over(upto))
    found = ordered.groupBy(*by).agg(F.max("_n").alias("_n"), *[
        F.min(F.when(F.col("_cum") > rank(F.col("_n")), F.struct("_cum", "_gap", F.col("_x").alias("v")))).alias(name) for name, rank in ranks.items()])
    checked = [F.when(F.col(name)["_gap"], F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(F.col(name)["v"]).alias(name) for name in ranks]
    return found.select(*by, "_n", *checked)


def _brackets(df: DataFrame, value: str, near: list[float], by: list[str]) -> DataFrame:
    """(by, _lo, _hi, _n): per share of ``near`` two values that enclose the ranks next to it (NULL: open, for groups of few values)."""
    slack = 4 / ACCURACY  # the sketch's error on either side, and ranks next to the share
    shares = [s for q in near for s in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = F.percentile_approx(value, shares, ACCURACY)
    found = df.where(F.col(value).isNotNull()).groupBy(*by).agg(sketch.alias("_s"), F.count(F.lit(1)).alias("_n"))
    ends = [F.array(*[F.when(F.col("_n") > 2 * ACCURACY, F.col("_s")[2 * k + side]) for k in range(len(near))]) for side in (0, 1)]
    return found.select(*by, ends[0].alias("_lo"), ends[1].alias("_hi"), "_n")


def _weighted_brackets(df: DataFrame, value: str, near: list[float], by: list[str], weight: str) -> DataFrame:
    """As ``_brackets`` for repeated values: cut points of the values, the weight between them, and the cuts around each rank."""
    rows = df.where(F.col(value).isNotNull())
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, [k / CUTS for k in range(1, CUTS)], 1000).alias("_cuts"))
    if by:
        rows = _join(rows, cuts, by)
    else:
        rows = rows.withColumn("_cuts", cuts.scalar())
    at = F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_bin")
    sums = rows.groupBy(*by, at).agg(F.sum(weight).alias("_c"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumns({"_n": F.sum("_c").over(whole), "_cum": F.sum("_c").over(upto)})
    # the bins that hold a rank within one place of the share
    first, last = F.col("_cum") - F.col("_c"), F.col("_cum") - 1
    holds = [(first <= F.ceil(F.lit(q) * F.col("_n")) + 1) & (last >= F.floor(F.lit(q) * F.col("_n")) - 1) for q in near]
    ends = [F.array(*[f(F.when(h, F.col(c))) for h in holds]) for f, c in ((F.min, "_min"), (F.max, "_max"))]
    return sums.groupBy(*by).agg(ends[0].alias("_lo"), ends[1].alias("_hi"), F.max("_n").alias("_n"))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join on keys where NULL equals NULL."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(named, all_of([F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])).drop(*[f"_r_{k}" for k in keys])


def rank_quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """``sorted(values)[int(q * n)]`` per group (the evaluator's p90/p95 rule).

    Groups whose values are all NULL are absent; n counts non-NULL values.
    """
    by = list(by or [])
    found = select_ranks(df, value, {name: (lambda n, q=q: F.floor(F.lit(q) * n)) for name, q in qs.items()}, list(qs.values()), by)
    return found.select(*by, F.col("_n").alias("n"), *qs)


def linear_quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group (pandas ``quantile``/``median`` semantics); ``weight`` repeats a value.
    Groups without a value are absent; without ``by`` there is always one row."""
    by = list(by or [])
    place = lambda n, q: F.lit(q) * (n - 1)
    ranks = {f"_lo_{name}": (lambda n, q=q: F.floor(place(n, q))) for name, q in qs.items()}
    ranks |= {f"_hi_{name}": (lambda n, q=q: F.ceil(place(n, q))) for name, q in qs.items()}
    found = select_ranks(df, value, ranks, list(qs.values()), by, weight)
    lo, hi = (lambda name: F.col(f"_lo_{name}").cast("double")), (lambda name: F.col(f"_hi_{name}").cast("double"))
    part = lambda q: place(F.col("_n"), q) - F.floor(place(F.col("_n"), q))
    return found.select(*by, *[(lo(name) + (hi(name) - lo(name)) * part(q)).alias(name) for name, q in qs.items()])


def equal_width_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal-width bins between min and max (last bin closed).

    Bin edges come from one scalar aggregate (a scalar subquery, evaluated
    once); each row's bin is ``floor((x - lo) * bins / (hi - lo))`` capped at
    ``bins - 1``; all bins are returned, empty ones with 0.
    """
    x = F.col(value).cast("double")
    stats = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    edges = stats.select(F.struct("lo", "hi")).scalar()
    lo, hi = edges.getField("lo"), edges.getField("hi")
    width = hi - lo
    bucket = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) * F.lit(bins) / width), F.lit(bins - 1))
    ).cast("int")
    counts = df.where(x.isNotNull()).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dims = stats.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return (
        dims.join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / F.lit(bins)).alias("bin_start"),
            (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 1) / F.lit(bins)).alias("bin_end"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        )
    )
