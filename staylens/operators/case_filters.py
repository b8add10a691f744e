"""F4/F18 over a table of cases: rows meet the cases whose conditions they satisfy, through equi-joins.

Conditions are rows (case_id, column, op, value). A case is looked up by the values of all its equality columns, or, if it has only
ranges, by the buckets of one ranged column that its interval touches; all its conditions are then tested on the few rows
found. So neither the plan nor a row's work grows with the number of cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import all_of
from .questions import _staged

OPS = ("gt", "lt", "eq")
#: Buckets of a ranged column.
BUCKETS = 64


def match_cases(rows: DataFrame, cases: DataFrame, specs: DataFrame, on_unknown: str = "error", case_id: str = "case_id") -> DataFrame:
    """``rows`` with ``case_id``: a row once for each case it satisfies. ``cases`` names the cases (those without conditions take all
    rows); ``specs`` has their conditions (case_id, column, op gt | lt | eq, value as text), all of which must hold.

    Numbers are compared as numbers, everything else as text; NULL satisfies nothing, nor does a value that is no number where one is
    wanted. Conditions on columns that ``rows`` lacks: ``error`` raises, ``ignore`` leaves them out, ``empty`` gives their case no rows.
    """
    if on_unknown not in ("error", "ignore", "empty"):
        raise ValueError(f"unknown mode {on_unknown!r}")
    wrong = specs.where(~F.col("op").isin(*OPS)).select("op").first()
    if wrong is not None:
        raise ValueError(f"unknown operator {wrong['op']!r} (use gt, lt, eq)")
    numeric = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)]
    known = F.col("column").isin(*rows.columns)
    unknown = specs.where(~known)
    if on_unknown == "error" and (first := unknown.select("column").first()) is not None:
        raise KeyError(f"unknown column {first['column']!r}")
    if on_unknown == "empty":
        cases = cases.join(unknown.select(case_id).distinct(), case_id, "left_anti")
    is_num = F.col("column").isin(*numeric)
    given = specs.where(known).select(case_id, "column", "op", F.when(is_num, F.col("value").try_cast("double")).alias("num"),
                                      F.when(~is_num, F.col("value")).alias("txt"), is_num.alias("is_num"))
    used = sorted(r["column"] for r in given.select("column").distinct().collect())  # at most the columns of the rows
    # a range is looked up by the first numeric column it has
    with_range = {r["column"] for r in given.where(is_num & (F.col("op") != "eq")).select("column").distinct().collect()}
    ranged = [c for c in used if c in with_range]
    cuts = _cuts(rows, ranged)
    bucket = lambda c, x: F.coalesce(*[F.when(c == n, sum((F.when(x > v, 1).otherwise(0) for v in cuts[n]), F.lit(0))) for n in ranged], F.lit(0)) if ranged else F.lit(0)
    text_of = F.coalesce(F.col("num").cast("string"), F.col("txt"))
    # a case's conditions on column k of ``used``, as what holds for all of them: it equals e and f (the least and the greatest value asked for),
    # lies above g and below l. No lambda runs on the rows
    operand = lambda c: F.col("num" if c in numeric else "txt")
    of = lambda f, c, op: f(F.when((F.col("column") == c) & (F.col("op") == op), operand(c)))
    limits = [of(f, c, op).alias(f"_{n}{k}") for k, c in enumerate(used) for n, f, op in (("e", F.min, "eq"), ("f", F.max, "eq"), ("g", F.max, "gt"), ("l", F.min, "lt"))]
    per_case = given.groupBy(case_id).agg(
        *limits, F.collect_list(F.struct("column", "op", "num")).alias("conds"), F.bool_or(F.col("num").isNull() & F.col("txt").isNull()).alias("never"),
        F.array_sort(F.collect_set(F.when(F.col("op") == "eq", F.col("column")))).alias("eq"),
        F.array_sort(F.collect_set(F.when(F.col("op") == "eq", F.struct("column", text_of.alias("v"))))).alias("values"),
        F.min(F.when((F.col("op") != "eq") & F.col("is_num"), F.col("column"))).alias("range"))
    per_case = cases.select(case_id).join(per_case, case_id, "left").where("never IS NULL OR NOT never")
    sign = F.when(F.size("eq") > 0, F.concat(F.lit("="), F.array_join("eq", ","))).when(F.col("range").isNotNull(), F.concat(F.lit("<"), F.col("range"))).otherwise("")
    bound = lambda op, f: f(F.transform(F.filter("conds", lambda c: (c["column"] == F.col("range")) & (c["op"] == op)), lambda c: c["num"]))
    lo, hi = bound("gt", F.array_max), bound("lt", F.array_min)
    first, last = F.when(lo.isNull(), 0).otherwise(bucket(F.col("range"), lo)), F.when(hi.isNull(), BUCKETS).otherwise(bucket(F.col("range"), hi))
    keys = (F.when(F.size("eq") > 0, F.array(F.array_join(F.transform("values", lambda v: v["v"]), "\x1f")))
            .when(F.col("range").isNotNull(), F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda b: b.cast("string"))).otherwise(F.array().cast("array<string>")))
            .otherwise(F.array(F.lit(""))))
    limited = [f"_{n}{k}" for k in range(len(used)) for n in "efgl"]
    asked = per_case.select(case_id, *[F.col(c) for c in limited], sign.alias("_sign"), F.explode(keys).alias("_key"))
    asked = _staged(asked, "asked")  # of known size: a small table of cases goes to the rows, whatever one key (that of all rows) holds
    signs = sorted(r["_sign"] for r in asked.select("_sign").distinct().collect())  # the sets of equality columns in use
    as_text = lambda c: F.coalesce(F.col(c).cast("double").cast("string") if c in numeric else F.col(c).cast("string"))

    def key_of(s: str) -> Column:
        if s.startswith("="):
            parts = [as_text(c) for c in s[1:].split(",")]
            null = F.array_contains(F.array(*[p.isNull() for p in parts]), True)
            return F.when(~null, F.concat_ws("\x1f", *parts))
        return bucket(F.lit(s[1:]), F.col(s[1:]).cast("double")).cast("string") if s else F.lit("")

    if not signs:
        return rows.limit(0).withColumn(case_id, F.lit(None).cast(cases.schema[case_id].dataType))
    places = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), key_of(s).alias("k")) for s in signs])).alias("_at")
    put = rows.select("*", places)
    met = put.join(asked, (F.col("_at.s") == F.col("_sign")) & (F.col("_at.k") == F.col("_key")))
    tests = []
    for k, c in enumerate(used):
        x = F.col(c).cast("double" if c in numeric else "string")
        given_by = {n: F.col(f"_{n}{k}") for n in "efgl"}
        holds = {"e": x == given_by["e"], "f": x == given_by["f"], "g": x > given_by["g"], "l": x < given_by["l"]}
        tests += [given_by[n].isNull() | F.coalesce(holds[n], F.lit(False)) for n in "efgl"]
    return (met.where(all_of(tests)) if tests else met).select(*rows.columns, case_id)


def _cuts(rows: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Cut points of each column; any rising numbers do."""
    if not columns:
        return {}
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 1000).alias(c) for c in columns]).first()
    return {c: sorted(set(found[c] or [])) for c in columns}
