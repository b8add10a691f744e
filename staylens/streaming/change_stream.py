"""Change feed as a stream — file source of change records -> ``apply_changes`` per micro-batch.

Each micro-batch reads the rows it names, applies its changes to them and commits the rows it made as a delta
of a merge-on-read table (``sources.change_store``), so its work follows the batch, not the table. Its changes are written
first, so every later read sees the same rows; its audit rows have a folder of their own; the commit comes last, with the
high-water id. A batch replayed after a failure (``foreachBatch`` is at-least-once) is skipped if it is committed and
done anew if not, so nothing is applied or logged twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import DELETE, apply_changes
from ..session import shared_path
from ..sources import change_store as S
from ..sources.schema import UPDATE_LOG_SCHEMA


def apply_batch(spark: SparkSession, root: str, base_path: str, batch: DataFrame, batch_id: int,
                now: str | None = None, compact_after: int = S.COMPACT_AFTER) -> None:
    """Apply one micro-batch idempotently (skip a batch id already applied); the first one starts the table from ``base_path``."""
    st = S.state(spark, root) or S.create(spark, root, spark.read.parquet(base_path))
    if batch_id <= st.batch:
        return
    mine = f"{root}/batches/{batch_id:010d}"
    batch.write.mode("overwrite").parquet(f"{mine}/changes")
    changes = spark.read.schema(batch.schema).parquet(f"{mine}/changes")
    S.lookup(spark, root, changes.where(F.col("id").isNotNull()).select("id")).write.mode("overwrite").parquet(f"{mine}/targets")
    targets = spark.read.schema(st.schema).parquet(f"{mine}/targets")
    res = apply_changes(targets, changes, high_water=st.mark, now=now)
    gone = res["status"].where(F.col("applied") & (F.col("op") == DELETE)).select("id")
    S.append_once(res["audit"], root, batch_id)
    S.merge(spark, root, batch_id, res["snapshot"], gone, res["high_water"].first()["id"], compact_after)


def update_log(spark: SparkSession, root: str) -> DataFrame:
    """The audit rows of all applied batches."""
    return S.read_log(spark, root, UPDATE_LOG_SCHEMA)


def start_change_stream(spark: SparkSession, changes_dir: str, schema: T.StructType, base_path: str,
                        root: str | None = None, available_now: bool = True, now: str | None = None):
    """Start the stream; ``available_now`` processes what is there and stops (tests, backfills)."""
    root = root or shared_path(spark, "change_stream")
    stream = spark.readStream.schema(schema).parquet(changes_dir)
    writer = (stream.writeStream.option("checkpointLocation", f"{root}/_checkpoint")
              .foreachBatch(lambda df, bid: apply_batch(spark, root, base_path, df, bid, now)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start(), root


def latest_snapshot(spark: SparkSession, root: str, base_path: str) -> DataFrame:
    """The table after the last applied batch."""
    return S.read(spark, root) if S.state(spark, root) else spark.read.parquet(base_path)
