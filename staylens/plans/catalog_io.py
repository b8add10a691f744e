"""Registered queries of sources and sinks (S1, S3, S4, S6): tables written to the shared store and read back through the engine."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import shared_path, show_code
from ..sources import snapshots as N
from ..sources.csv import checked_payload, read_bookings_csv
from ..sources.schema import RAW_FIELDS
from ..sources.tables import bookings, bookings_view_sql
from .catalog import bk, register, rounded
from .sqltext import clean_ctes

RAW = f"WITH raw AS ({bookings_view_sql()})"


def _place(spark, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("csv_scan", RAW + """ SELECT hotel, CAST(count(*) AS BIGINT) AS n, CAST(count(country) AS BIGINT) AS with_country, CAST(count(agent) AS BIGINT) AS with_agent,
  CAST(sum(lead_time) AS BIGINT) AS lead_time, ROUND(sum(adr), 2) AS adr, ROUND(sum(children), 6) AS children, max(reservation_status_date) AS last_date FROM raw GROUP BY hotel""")
def q_csv_scan(spark, sf_dir):
    """The raw bookings as CSV files (three NULL tokens, headers), read back with types."""
    raw, path = bookings(spark, sf_dir), _place(spark, "csv")
    token = F.element_at(F.array(F.lit("NA"), F.lit("NULL"), F.lit("")), (F.col("id") % 3 + 1).cast("int"))
    raw.select(*[F.coalesce(F.col(c).cast("string"), token).alias(c) for c, _ in RAW_FIELDS]).write.option("header", True).csv(path)
    return rounded(read_bookings_csv(spark, path).groupBy("hotel").agg(
        F.count(F.lit(1)).alias("n"), F.count("country").alias("with_country"), F.count("agent").alias("with_agent"), F.sum("lead_time").alias("lead_time"),
        F.round(F.sum("adr"), 2).alias("adr"), F.sum("children").alias("children"), F.max("reservation_status_date").alias("last_date")))


@register("import_scan", clean_ctes() + """ SELECT hotel, arrival_date_year, CAST(count(*) AS BIGINT) AS n, ROUND(sum(revenue), 2) AS revenue, min(lead_time) AS shortest, max(lead_time) AS longest
FROM bk WHERE arrival_date_year BETWEEN 1995 AND 1996 AND lead_time BETWEEN 30 AND 90 GROUP BY ALL""")
def q_import_scan(spark, sf_dir):
    """S3 + S4: cleaned bookings published with a manifest (a second version over a first), then a ranged scan that opens only files that can match."""
    root = _place(spark, "snapshot")
    rows = bk(spark, sf_dir)
    N.publish(rows.where("hotel = 'City Hotel'"), root)
    N.publish(rows, root)
    found = N.scan(spark, root, {"arrival_date_year": (1995, 1996), "lead_time": (30, 90)})
    return found.groupBy("hotel", "arrival_date_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("revenue"), 2).alias("revenue"),
                                                           F.min("lead_time").alias("shortest"), F.max("lead_time").alias("longest"))


def _as_arrays(batches):
    """Rows of one task as the lines of one JSON array."""
    first = True
    for batch in batches:
        lines = [("[" if first and k == 0 else ",") + v for k, v in enumerate(batch.column("value").to_pylist())]
        if lines:
            first = False
            yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])


@register("payload_array", RAW + """ SELECT CASE WHEN id % 97 = 0 THEN 'rejected' ELSE 'valid' END AS kind, CASE WHEN id % 97 <> 0 THEN hotel END AS hotel, CAST(count(*) AS BIGINT) AS n,
  ROUND(sum(CASE WHEN id % 97 <> 0 THEN adr END), 2) AS adr, CAST(count(CASE WHEN id % 97 <> 0 THEN children END) AS BIGINT) AS with_children FROM raw GROUP BY ALL""")
def q_payload_array(spark, sf_dir):
    """S6 + A4: bookings as large JSON arrays, cut by the splittable scanner; rows that name an unknown column are rejected."""
    raw, path = bookings(spark, sf_dir), _place(spark, "payload")
    fields = [F.col(c) for c, _ in RAW_FIELDS]
    value = F.when(F.col("id") % 97 == 0, F.to_json(F.struct(*fields, F.lit("[red, {").alias("colour")))).otherwise(F.to_json(F.struct(*fields)))
    show_code(spark)
    tasks = max(3, spark.sparkContext.defaultParallelism)
    raw.repartition(tasks, "id").select(value.alias("value")).mapInArrow(_as_arrays, "value string").write.text(path)
    checked = checked_payload(spark, path, "array")
    r = lambda c: F.when(~F.col("invalid"), F.col("r").getField(c))
    return checked.groupBy(F.when(F.col("invalid"), "rejected").otherwise("valid").alias("kind"), r("hotel").alias("hotel")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(r("adr")), 2).alias("adr"), F.count(r("children")).alias("with_children"))
