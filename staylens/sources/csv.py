"""CSV scan of a reservations file (S1) with the service's NULL-token semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_array import read_elements
from .schema import CSV_NULL_TOKENS, RAW_FIELDS


def _typed(c: Column, dtype: T.DataType) -> Column:
    """Token list -> NULL, then a non-failing cast (bad numbers become NULL)."""
    cleaned = F.when(F.trim(c).isin(CSV_NULL_TOKENS) | c.isNull(), F.lit(None)).otherwise(c)
    if isinstance(dtype, T.StringType):
        return cleaned
    if isinstance(dtype, T.IntegerType):
        # integral text such as "3.0" is accepted like the original float->int reading
        return F.coalesce(cleaned.try_cast("int"), cleaned.try_cast("double").try_cast("int"))
    return cleaned.try_cast(dtype)


def read_bookings_csv(spark: SparkSession, path: str, fields=RAW_FIELDS) -> DataFrame:
    """Read a header CSV as text, map every NULL token, then ``try_cast`` to the schema.

    Spark's reader accepts one ``nullValue``; reading as STRING and mapping the
    whole token list keeps the service's behaviour (``NA``, ``NULL``, empty ...).
    Columns missing from the file come back as NULL.
    """
    text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    present = set(text.columns)
    cols = []
    for name, dtype in fields:
        src = F.col(f"`{name}`") if name in present else F.lit(None).cast("string")
        cols.append(_typed(src, dtype).alias(name))
    return text.select(*cols)


def checked_payload(spark: SparkSession, path: str, layout: str = "lines", fields=RAW_FIELDS) -> DataFrame:
    """(value, unknown, invalid, r): each row of a JSON batch of bookings, its keys outside the schema, whether it is
    invalid, and the booking read from it. Both kinds of rows come from one pass over the batch.

    ``layout`` is ``lines`` (an object a line) or ``array`` (one JSON array a file), whatever the store. A row is
    invalid when it is not a JSON object or names a key outside the schema (the original insert failed on
    unknown columns); missing keys are NULL. No row leaves the executors.
    """
    allowed = F.array(*[F.lit(n) for n, _ in fields])
    schema = T.StructType([T.StructField(n, t, True) for n, t in fields])
    if layout == "lines":
        text = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    elif layout == "array":
        text = read_elements(spark, path)  # a file that is no array is one invalid row
    else:
        raise ValueError(f"unknown layout {layout!r}")
    as_map = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    unknown = F.array_except(F.map_keys(as_map), allowed)
    return text.select("value", unknown.alias("unknown"), (as_map.isNull() | (F.size(unknown) > 0)).alias("invalid"), F.from_json("value", schema).alias("r"))


def read_payload(spark: SparkSession, path: str, layout: str = "lines", fields=RAW_FIELDS) -> tuple[DataFrame, DataFrame]:
    """``checked_payload`` split into (valid rows, invalid rows: value and unknown keys)."""
    checked = checked_payload(spark, path, layout, fields)
    return checked.where(~F.col("invalid")).select("r.*"), checked.where("invalid").select("value", "unknown")


def read_bookings_json(spark: SparkSession, path: str, layout: str = "lines", fields=RAW_FIELDS) -> DataFrame:
    """The valid bookings of a JSON batch (see ``read_payload``, which also gives the rejected rows)."""
    return read_payload(spark, path, layout, fields)[0]
