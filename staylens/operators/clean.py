"""Cleaning and derivation of reservation rows.

All steps are row-local column expressions except the data-dependent
imputation (C7). Its fill values come from one aggregate in a scalar subquery, so
nothing runs while a plan is built, and a query that uses none of the columns
that may be filled reads its source once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import positive_flag, right_closed_bins
from ..sources.schema import (
    CONSTANT_FILLS, INT_FLAGS, LEAD_EDGES, LEAD_LABELS, MEAN_FILL_MIN_DISTINCT, MISSING_TEXT,
    PRESENCE_FLAGS, STRING_COLUMNS, WAITLIST_EDGES, WAITLIST_LABELS,
)

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row, one BIGINT per column = number of NULLs (one scan, one agg)."""
    cols = columns or df.columns
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def fill_constants(df: DataFrame, style: str = "service") -> DataFrame:
    """Constant fills.

    service:  children -> 0, agent -> -1, company -> -1
    notebook: children -> 0, agent/company -> 'None' (text), country NULL -> 'Unknown', 'EST' -> 'ESTO'
    """
    if style == "service":
        return df.fillna({k: v for k, v in CONSTANT_FILLS.items() if k in df.columns})
    if style == "notebook":
        out = df.fillna({"children": 0.0})
        for c in ("agent", "company"):
            # numbers print as Python floats do ('9.0'); missing -> 'None'
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double").cast("string"), F.lit("None")))
        out = out.withColumn("country", F.coalesce(F.col("country"), F.lit("Unknown")))
        return out.withColumn("country", F.when(F.col("country") == "EST", F.lit("ESTO")).otherwise(F.col("country")))
    raise ValueError(f"unknown style {style!r}")


def cast_flags(df: DataFrame) -> DataFrame:
    """0/1 flags as INT."""
    return df.withColumns({c: F.col(c).cast("int") for c in INT_FLAGS if c in df.columns})


def normalise_strings(df: DataFrame) -> DataFrame:
    """NULL / 'nan' / 'None' in the text columns -> 'Unknown'."""
    def norm(c: str) -> Column:
        x = F.col(c).cast("string")
        return F.coalesce(F.when(~x.isin(*MISSING_TEXT), x), F.lit("Unknown"))  # never NULL by its schema: nothing to impute

    return df.withColumns({c: norm(c) for c in STRING_COLUMNS if c in df.columns})


def may_be_null(df: DataFrame, exclude: tuple[str, ...] = ("id",)) -> list[str]:
    """The numeric and text columns that may hold NULLs by the schema."""
    return [f.name for f in df.schema.fields
            if f.nullable and f.name not in exclude and (_is_numeric(f.dataType) or isinstance(f.dataType, T.StringType))]


def impute(df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = ("id",)) -> DataFrame:
    """Data-dependent fill of the remaining NULLs.

    Numeric column: more than 30 distinct values -> mean, else mode. Text column -> mode.
    Mode ties take the smallest value; an all-NULL column stays NULL. Integral
    columns keep their type (a mean fill is rounded half-up).

    ``columns`` defaults to every numeric and text column that may hold NULLs by its schema.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    todo = columns if columns is not None else may_be_null(df, exclude)
    if not todo:
        return df
    # a value sets the bit of 64 that its hash names, so more than MEAN_FILL_MIN_DISTINCT bits are as many values for certain: such a numeric
    # column takes its mean. Only the values of the other columns with a NULL are counted (in the tasks first), a row for each of these
    # columns and no other, so no column of many numbers is shuffled
    numeric = [i for i, c in enumerate(todo) if _is_numeric(types[c])]
    number = lambda c: F.col(c).cast("double") + F.lit(0.0)  # noqa: E731  (-0.0 is 0.0)
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    bits = [F.bit_or(F.when(F.col(todo[i]).isNotNull(), bit(number(todo[i])))).alias(f"b{i}") for i in numeric]
    means = [F.avg(F.col(todo[i]).cast("double")).alias(f"m{i}") for i in numeric]
    holes = [(F.count_if(F.col(c).isNull()) > 0).alias(f"h{i}") for i, c in enumerate(todo)]
    found = df.agg(*bits, *means, *holes)
    many = lambda i: F.coalesce(F.bit_count(f"b{i}") > MEAN_FILL_MIN_DISTINCT, F.lit(False))
    counted = F.array_compact(F.array(*[F.when(F.col(f"h{i}") & ~many(i) if i in numeric else F.col(f"h{i}"), F.lit(i)) for i in range(len(todo))]))
    first = found.select(F.struct(counted.alias("counted"), *[F.struct(many(i).alias("many"), F.col(f"m{i}").alias("mean")).alias(f"c{i}") for i in numeric])).scalar()

    def value(of: list[int], dtype: str) -> Column:
        out = F.lit(None).cast(dtype)
        for i in of:
            out = F.when(F.col("_i") == i, F.col(todo[i]).cast(dtype)).otherwise(out)
        return out

    text = [i for i in range(len(todo)) if i not in numeric]
    each = df.select(*todo).withColumn("_first", first).select(*todo, F.explode("_first.counted").alias("_i"))
    known = each.select(F.col("_i").alias("i"), value(numeric, "double").alias("num"), value(text, "string").alias("txt")).where("num IS NOT NULL OR txt IS NOT NULL")
    counts = known.groupBy("i", "num", "txt").agg(F.count(F.lit(1)).alias("n"))
    most = F.struct(-F.col("n"), "num", "txt")
    per = counts.groupBy("i").agg(F.count(F.lit(1)).alias("distinct"), F.min_by("num", most).alias("num"), F.min_by("txt", most).alias("txt"))
    stats = per.agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("distinct", "num", "txt"))))).scalar()

    def fill(i: int, c: str) -> Column:
        found = F.try_element_at("_fill", F.lit(i))
        if i not in numeric:
            return found.getField("txt")
        mean = F.col("_first").getField(f"c{i}").getField("mean")
        if not isinstance(types[c], (T.FloatType, T.DoubleType, T.DecimalType)):
            mean = F.round(mean, 0)
        many = F.col("_first").getField(f"c{i}").getField("many")
        return F.when(many | (found.getField("distinct") > MEAN_FILL_MIN_DISTINCT), mean).otherwise(found.getField("num")).cast(types[c])

    filled = df.withColumn("_first", first).withColumn("_fill", stats)
    return filled.withColumns({c: F.coalesce(F.col(c), fill(i, c)) for i, c in enumerate(todo)}).drop("_fill", "_first")


def parse_dates(df: DataFrame, column: str = "reservation_status_date") -> DataFrame:
    """``yyyy-MM-dd`` text -> DATE; unparsable -> NULL."""
    return df.withColumn(column, F.try_to_date(F.col(column).cast("string"), "yyyy-MM-dd"))


def totals(df: DataFrame, zero_missing: bool = False, only_missing: bool = False) -> DataFrame:
    """Total nights and guests, revenue.

    ``zero_missing`` counts an absent part as 0 (rows added one by one); otherwise a NULL part gives NULL.
    ``only_missing`` keeps given totals and computes only absent ones.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(0)) if zero_missing else F.col(c)
    given = lambda c, x: F.coalesce(F.col(c), x) if only_missing and c in df.columns else x
    nights = (part("stays_in_weekend_nights") + part("stays_in_week_nights")).cast("int")
    guests = (part("adults") + part("children") + part("babies")).cast("double")
    out = df.withColumns({"total_nights": given("total_nights", nights), "total_guests": given("total_guests", guests)})
    return out.withColumn("revenue", given("revenue", (part("adr") * F.col("total_nights")).cast("double")))


def derive(df: DataFrame, zero_missing: bool = False) -> DataFrame:
    """Totals, revenue, presence flags and bins."""
    out = totals(df, zero_missing)
    out = out.withColumns({flag: positive_flag(src) for flag, src in PRESENCE_FLAGS.items()})
    return out.withColumns({
        "waitlist_category": right_closed_bins("days_in_waiting_list", WAITLIST_EDGES, WAITLIST_LABELS),
        "lead_time_category": right_closed_bins("lead_time", LEAD_EDGES, LEAD_LABELS),
    })


def stamp(df: DataFrame, now: str | None = None) -> DataFrame:
    """``last_updated`` = now (or a given timestamp literal)."""
    ts = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return df.withColumn("last_updated", ts)


def clean(df: DataFrame, style: str = "service", now: str | None = None, impute_columns: list[str] | None = None) -> DataFrame:
    """C2-C15 in the service's order: fills, flags, text, imputation, dates, derived columns, stamp."""
    out = fill_constants(df, style)
    out = cast_flags(out)
    out = normalise_strings(out)
    out = impute(out, impute_columns)
    out = parse_dates(out)
    out = derive(out)
    return stamp(out, now)


def describe(df: DataFrame) -> DataFrame:
    """C17: (id, description) text per booking, as built for the text encoder."""
    from ..functions.text import describe_booking

    return df.select("id", describe_booking().alias("description"))


def sample_n(df: DataFrame, n: int = 2500, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, repeatable for a given seed.

    Rows are ranked by the MD5 of key and seed and the first ``n`` kept
    (TakeOrderedAndProject: each task keeps its own top n, the driver merges
    ``n`` per task), so no full sort or shuffle of the table happens.
    """
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f" {seed}"))), F.col(key)).limit(n)


def clean_staged(df: DataFrame, staging_path: str, style: str = "service", now: str | None = None) -> DataFrame:
    """``clean`` for large ingests: the source is evaluated once.

    The row-local steps (fills, flags, text) are written to ``staging_path``
    (a folder on the shared store); the imputation statistics are then read
    column-wise from that Parquet copy instead of re-running the source (for
    example a join).
    """
    staged = normalise_strings(cast_flags(fill_constants(df, style)))
    staged.write.mode("errorifexists").parquet(staging_path)
    out = impute(df.sparkSession.read.schema(staged.schema).parquet(staging_path), may_be_null(staged))  # files tell no column as never NULL
    out = parse_dates(out)
    out = derive(out)
    return stamp(out, now)
