"""Table changes as DataFrame change application (A1-A5) with an audit log.

``changes`` rows: seq BIGINT (order), op STRING (add | update | delete),
id BIGINT (target of update/delete), changed_columns ARRAY<STRING> (columns an
update sets; NULL for add = all given columns), plus one nullable column per
booking field carrying the new values.

Semantics (one change at a time, in ``seq`` order, like the row-by-row service):
* adds get fresh ids above the high-water mark, in ``seq`` order (ids are never
  reused, so a deleted last id does not come back); the mark of a snapshot is
  returned with it and given to the next batch;
* update/delete of an id that does not exist (yet, or no longer) is not applied; an id
  added earlier in the same feed exists;
* the first applied delete of an id removes it; later changes to it are not applied;
* partial updates accumulate column by column: each column takes the value of
  the latest applied update that set it (``max_by`` over those updates only).

So a feed gives the same rows however it is cut into batches.

Work: ids for the adds, one aggregate of the changes per id, one left join of
the base table and the added rows with that (change-sized) table. A feed can be
as large as the table, and the columns needed of its packed files look smaller
than their rows are, so none of these joins is left to become a broadcast; only
the offsets of the ids (one row per partition) are sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import clean as C

ADD, UPDATE, DELETE = "add", "update", "delete"
# audit operation names and details (fixed values of the original service)
OPERATION = {ADD: "add_booking", UPDATE: "update_booking", DELETE: "delete_booking"}


def change_status(base: DataFrame, changes: DataFrame, added: DataFrame) -> DataFrame:
    """(seq, op, id, applied) for every change; adds (``added``: seq, id) are always applied.

    The base table is only scanned for the changed ids; an added id exists from its ``seq`` on.
    """
    ud = changes.where(F.col("op").isin(UPDATE, DELETE)).select("seq", "op", "id")
    old = base.select("id").join(ud.select("id").distinct().hint("merge"), "id", "left_semi").select("id", F.lit(None).cast("long").alias("_since"))
    there = old.unionByName(added.select("id", F.col("seq").alias("_since"))).withColumn("_there", F.lit(True))
    ud = ud.join(there.hint("merge"), "id", "left")
    exists = F.coalesce(F.col("_there") & (F.col("_since").isNull() | (F.col("_since") < F.col("seq"))), F.lit(False))
    ud = ud.withColumn("_exists", exists)
    first_del = ud.where((F.col("op") == DELETE) & F.col("_exists")).groupBy("id").agg(F.min("seq").alias("_del_seq"))
    ud = ud.join(first_del.hint("merge"), "id", "left")
    applied = F.col("_exists") & F.when(F.col("op") == UPDATE, F.col("_del_seq").isNull() | (F.col("seq") < F.col("_del_seq"))).otherwise(
        F.col("seq") == F.col("_del_seq"))
    adds = added.select("seq", F.lit(ADD).alias("op"), F.lit(None).cast("long").alias("id"), F.lit(True).alias("applied"))
    return ud.select("seq", "op", "id", applied.alias("applied")).unionByName(adds)


def fold_updates(changes: DataFrame, status: DataFrame, columns: list[str]) -> DataFrame:
    """Per id: for each column the latest applied value that set it (struct, NULL = untouched), and delete flag."""
    ok = status.where(F.col("applied") & (F.col("op") != ADD)).select("seq")
    applied = changes.join(ok.hint("merge"), "seq", "left_semi").where(F.col("op").isin(UPDATE, DELETE))
    sets = lambda c: F.when((F.col("op") == UPDATE)
                            & F.coalesce(F.array_contains(F.col("changed_columns"), F.lit(c)), F.lit(False)), F.col("seq"))
    return applied.groupBy("id").agg(
        F.max(F.col("op") == DELETE).alias("_deleted"),
        *[F.max_by(F.struct(F.col(c).alias("v")), sets(c)).alias(f"_u_{c}") for c in columns],
    )


def assign_ids(adds: DataFrame, high_water: Column | int, order: str = "seq", partitions: int | None = None) -> DataFrame:
    """Dense new ids ``high_water + 1 ..`` in ``order``, without a global window.

    Rows are range-partitioned on ``order`` and their partition number stored
    with them in a table written once to the shared checkpoint folder, so the
    numbers stay fixed even if a later task is retried; the per-partition counts
    (one row per partition) give each partition its offset; inside a partition
    the rank is a window over that partition only.
    """
    import uuid

    from pyspark.sql import Window

    from ..session import shared_path

    spark = adds.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, f"ids-{uuid.uuid4().hex}")
    adds.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_off"))
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    hw = high_water if isinstance(high_water, Column) else F.lit(high_water)
    return (local.join(F.broadcast(offsets), "_p")  # one row per partition; unasked, Spark may send the added rows instead
            .withColumn("id", (hw + F.col("_off") + F.col("_r")).cast("long"))
            .drop("_p", "_off", "_r"))


def apply_changes(base: DataFrame, changes: DataFrame, high_water: int | Column | None = None, now: str | None = None,
                  recompute: bool = True) -> dict[str, DataFrame]:
    """A1-A5: new ``snapshot``, per-change ``status``, ``audit`` rows, ``added`` (seq, id) and ``high_water`` (one row, ``id``).

    ``high_water`` is the mark that came with ``base``; without one it is the largest id of ``base``. Absent parts of
    an added booking's totals count as 0. ``recompute`` re-derives totals, flags and bins of the rows; without it
    (the service's way) added rows get their three totals and no flags or bins, and updates recompute nothing.
    """
    from ..sources.schema import RAW_COLUMNS

    columns = [c for c in RAW_COLUMNS if c in changes.columns and c in base.columns]
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    top = F.coalesce(base.select(F.max("id")).scalar(), F.lit(0))
    mark = top if high_water is None else F.greatest(top, high_water if isinstance(high_water, Column) else F.lit(high_water))
    new_rows = assign_ids(changes.where(F.col("op") == ADD).select("seq", *columns), mark)
    added = new_rows.select("seq", "id")
    # missing fields are NULL (the insert names only the given columns)
    new_rows = new_rows.select(*[F.col(f.name) if f.name in new_rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                                 for f in base.schema.fields])
    if "total_nights" in base.columns:
        new_rows = C.totals(new_rows, zero_missing=True, only_missing=True)
    if "last_updated" in base.columns:
        new_rows = new_rows.withColumn("last_updated", stamp)

    status = change_status(base, changes, added)
    folded = fold_updates(changes, status, columns)
    joined = base.unionByName(new_rows.select(*base.columns)).join(folded.hint("merge"), "id", "left")
    touched = F.col("_deleted").isNotNull()
    kept = joined.where(~F.coalesce(F.col("_deleted"), F.lit(False)))
    values = {c: F.when(F.col(f"_u_{c}").isNotNull(), F.col(f"_u_{c}.v")).otherwise(F.col(c)) for c in columns}
    snapshot = kept.withColumns(values)
    if "last_updated" in base.columns:
        snapshot = snapshot.withColumn("last_updated", F.when(touched, stamp).otherwise(F.col("last_updated")))
    if recompute:
        # derived columns are a function of the raw ones: re-deriving changes only touched and added rows
        snapshot = C.derive(snapshot, zero_missing=True)
    snapshot = snapshot.select(*base.columns)
    water = base.sparkSession.range(1).select(F.coalesce(added.agg(F.max("id")).scalar(), mark).cast("long").alias("id"))
    return {"snapshot": snapshot, "status": status, "audit": audit_rows(changes, status, stamp), "added": added, "high_water": water}


def audit_rows(changes: DataFrame, status: DataFrame, stamp: Column) -> DataFrame:
    """One update-log row per applied change (id = change seq)."""
    ok = status.where("applied").select("seq", "op", F.col("id").alias("_target"))
    country = changes.select("seq", (F.coalesce(F.col("country"), F.lit("Unknown")) if "country" in changes.columns
                                     else F.lit("Unknown")).alias("_country"))
    rows = ok.join(country.hint("merge"), "seq", "left")
    details = (F.when(F.col("op") == ADD, F.concat(F.lit("Added booking for "), F.col("_country")))
               .when(F.col("op") == UPDATE, F.concat(F.lit("Updated booking ID "), F.col("_target").cast("string")))
               .otherwise(F.concat(F.lit("Deleted booking ID "), F.col("_target").cast("string"))))
    op_name = F.element_at(F.create_map(*[x for k, v in OPERATION.items() for x in (F.lit(k), F.lit(v))]), F.col("op"))
    return rows.select(F.col("seq").cast("long").alias("id"), stamp.alias("timestamp"), op_name.alias("operation"),
                       F.lit(1).cast("long").alias("record_count"), details.alias("details"))
