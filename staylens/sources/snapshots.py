"""Published snapshots with a manifest of files, so a failed write is never seen and a scan opens only files that can match.

A version is a folder of data files and a manifest with a row per file: its path, rows, and the least and largest value of some
columns. The manifest is written last; a version without a complete one does not exist for readers.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .change_store import _names
from .sinks import PARTITION_COLUMNS

#: Columns whose ranges the manifest holds.
STATS = ["arrival_date_year", "lead_time", "adr", "id"]


def publish(df: DataFrame, root: str, stats: list[str] | None = None, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as the next version below ``root``; returns the manifest's folder. Two writers of one version: the second fails.

    Rows are rebalanced by the partition columns and sorted by the first ranged column inside files, so files have narrow ranges.
    """
    spark = df.sparkSession
    partition_by = PARTITION_COLUMNS if partition_by is None else partition_by
    stats = [c for c in (STATS if stats is None else stats) if c in df.columns]
    done = _names(spark, f"{root}/manifests", done=True)
    number = int(done[-1]) + 1 if done else 0
    data = f"{root}/data/{number:010d}-{uuid.uuid4().hex}"
    dealt = df.hint("rebalance", *partition_by) if partition_by else df
    dealt.sortWithinPartitions(*partition_by, *stats[:1]).write.partitionBy(*partition_by).parquet(data)
    found = spark.read.schema(df.schema).parquet(data)
    ranges = [F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")).alias(c) for c in stats]
    files = found.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), *ranges)
    manifest = f"{root}/manifests/{number:010d}"
    files.withColumns({"data": F.lit(data), "schema": F.lit(df.schema.json())}).write.mode("errorifexists" if manifest in versions(spark, root) else "overwrite").parquet(manifest)
    return manifest


def versions(spark: SparkSession, root: str) -> list[str]:
    """Manifests of the complete versions, oldest first."""
    return [f"{root}/manifests/{n}" for n in _names(spark, f"{root}/manifests", done=True)]


def files(spark: SparkSession, manifest: str, bounds: dict[str, tuple] | None = None) -> DataFrame:
    """The manifest's rows of the files that may hold a row within all ``bounds`` ({column: (lo, hi)}, None: open)."""
    rows = spark.read.parquet(manifest)
    for c, (lo, hi) in (bounds or {}).items():
        if c in rows.columns:
            rows = rows.where((F.col(f"{c}.n") > 0) & (F.lit(True) if lo is None else F.col(f"{c}.hi") >= lo) & (F.lit(True) if hi is None else F.col(f"{c}.lo") <= hi))
    return rows


def scan(spark: SparkSession, root: str, bounds: dict[str, tuple] | None = None, version: int = -1) -> DataFrame:
    """Rows of a version (the newest) within all ``bounds``, both ends included; only files that may hold some are opened. The paths
    of these files come to the driver, as they do for any scan."""
    manifest = versions(spark, root)[version]
    wanted = files(spark, manifest, bounds).select("path", "data", "schema").collect()
    if not wanted:
        whole = spark.read.parquet(manifest).select("schema").first()
        return spark.createDataFrame([], T.StructType.fromJson(json.loads(whole["schema"])) if whole else T.StructType([]))
    schema = T.StructType.fromJson(json.loads(wanted[0]["schema"]))
    rows = spark.read.schema(schema).option("basePath", wanted[0]["data"]).parquet(*[unquote(r["path"]) for r in wanted])  # Spark gives paths as URIs
    for c, (lo, hi) in (bounds or {}).items():
        rows = rows.where((F.lit(True) if lo is None else F.col(c) >= lo) & (F.lit(True) if hi is None else F.col(c) <= hi))
    return rows
