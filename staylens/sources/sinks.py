"""Sinks (S3, S7-S9): snapshot tables, JSON results, append-only logs.

Paths are folders on the shared store (the cluster's ``spark.checkpoint.dir``
area or any URI the caller passes); nothing is written to a machine-local path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as C
from ..sources.schema import UPDATE_LOG_SCHEMA

PARTITION_COLUMNS = ["hotel", "arrival_date_year"]


def write_snapshot(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Store a bookings snapshot as Parquet partitioned by hotel and arrival year.

    Partition columns give file pruning for the common hotel/year filters; rows are rebalanced by them before the
    write, so a small partition is one file and a large one is split; a new snapshot is a new folder.
    """
    df.hint("rebalance", *PARTITION_COLUMNS).write.mode(mode).partitionBy(*PARTITION_COLUMNS).parquet(path)
    return path


def read_snapshot(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def initial_import(raw: DataFrame, path: str, log_path: str, source: str, now: str | None = None,
                   sample: int | None = None) -> DataFrame:
    """S3: (optionally sample) and clean the raw rows, write the snapshot, append the import log row."""
    if sample is not None:
        raw = C.sample_n(raw, sample)  # before cleaning: fill values are those of the sample
    cleaned = C.clean_staged(raw, f"{path.rstrip('/')}_staging", now=now)
    write_snapshot(cleaned, path, "errorifexists")
    stored = read_snapshot(raw.sparkSession, path)
    n = stored.count()
    ts = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    log = raw.sparkSession.range(1).select(
        F.lit(1).cast("long").alias("id"), ts.alias("timestamp"), F.lit("initial_import").alias("operation"),
        F.lit(n).cast("long").alias("record_count"), F.lit(f"Imported from {source}").alias("details"))
    append_log(log.select(*[f.name for f in UPDATE_LOG_SCHEMA.fields]), log_path)
    return stored


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only history / update-log table."""
    rows.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result rows as JSON lines (nested values become JSON objects/arrays)."""
    df.write.mode(mode).json(path)


def to_json_column(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON string column (``to_json(struct(*))``)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
