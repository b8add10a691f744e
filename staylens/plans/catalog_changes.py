"""Registered change-application queries (A1-A5, S9, L4) over a change feed derived from ``events``.

The stand-in feed only maps event rows into the change schema (op from the
event type, target id and new values from the event's own columns); the
change application itself runs through ``operators.changes``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as A
from ..operators import metrics as M
from ..operators.topk import recent
from ..session import shared_path
from ..sources.tables import read_table
from ..streaming.change_stream import apply_batch, latest_snapshot, update_log
from .catalog import bk, register, rounded
from .sqltext import clean_ctes

CHANGE_STAMP = "2024-02-01 00:00:00"


def change_feed(spark, sf_dir: str, ops: tuple[str, ...] = ("add", "update", "delete")) -> DataFrame:
    """events -> changes (seq, op, id, changed_columns, booking fields).

    A quarter of the targets lie around the largest booking id, so some are added earlier (or later) in the same
    feed and the highest ids are deleted before an add; some added bookings lack parts of their totals.
    """
    top = read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).scalar()
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").try_cast("int")
    et = F.col("event_type")
    op = F.when(et.isin("purchase", "signup"), F.lit("add")).when(et.isin("click", "view"), F.lit("update")) \
        .otherwise(F.lit("delete"))
    is_add = et.isin("purchase", "signup")
    out = ev.select(
        F.col("event_id").cast("long").alias("seq"),
        op.alias("op"),
        F.when(~is_add, F.when(F.col("event_id") % 4 == 0, top - 10 + F.col("event_id") % 200)
               .otherwise(F.col("event_id") * 4 + F.col("user_id") % 4 + 1)).cast("long").alias("id"),
        F.when(et == "click", F.array(F.lit("adr"), F.lit("days_in_waiting_list")))
        .when(et == "view", F.array(F.lit("total_of_special_requests"), F.lit("booking_changes"))).alias("changed_columns"),
        F.when(is_add, F.when(F.col("user_id") % 3 == 0, F.lit("Resort Hotel")).otherwise(F.lit("City Hotel"))).alias("hotel"),
        F.when(is_add, F.year("ts")).cast("int").alias("arrival_date_year"),
        F.when(is_add, F.date_format("ts", "MMMM")).alias("arrival_date_month"),
        F.when(is_add, k % 3).cast("int").alias("stays_in_weekend_nights"),
        F.when(is_add & (F.col("user_id") % 6 != 0), 1 + k % 7).cast("int").alias("stays_in_week_nights"),
        F.when(is_add, 1 + F.col("user_id") % 4).cast("int").alias("adults"),
        F.when(is_add & (F.col("user_id") % 5 != 0), F.lit(1.0)).alias("children"),
        F.when(is_add & (F.col("user_id") % 7 != 0), F.lit(0)).cast("int").alias("babies"),
        F.when(is_add, F.lit(0)).cast("int").alias("is_canceled"),
        F.when(is_add, k).cast("int").alias("lead_time"),
        F.when(is_add | (et == "click"), F.col("value")).alias("adr"),
        F.when(et == "click", k % 60).when(is_add, F.lit(0)).cast("int").alias("days_in_waiting_list"),
        F.when(is_add | (et == "view"), k % 6).cast("int").alias("total_of_special_requests"),
        F.when(et == "view", k % 4).when(is_add, F.lit(0)).cast("int").alias("booking_changes"),
    )
    return out.where(F.col("op").isin(*ops))


def _feed_sql(ops: tuple[str, ...]) -> str:
    ins = ", ".join(f"'{o}'" for o in ops)
    return f"""ch AS (SELECT * FROM (SELECT CAST(event_id AS BIGINT) AS seq,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'add' WHEN event_type IN ('click', 'view') THEN 'update'
         ELSE 'delete' END AS op,
    CASE WHEN event_type NOT IN ('purchase', 'signup') THEN CAST(CASE WHEN event_id % 4 = 0 THEN (SELECT max(o_orderkey) FROM orders) - 10 + event_id % 200
      ELSE event_id * 4 + user_id % 4 + 1 END AS BIGINT) END AS id,
    CASE WHEN event_type = 'click' THEN ['adr', 'days_in_waiting_list']
         WHEN event_type = 'view' THEN ['total_of_special_requests', 'booking_changes'] END AS changed_columns,
    CASE WHEN event_type IN ('purchase', 'signup') THEN CASE WHEN user_id % 3 = 0 THEN 'Resort Hotel' ELSE 'City Hotel' END END AS hotel,
    CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN year(ts) END AS INT) AS arrival_date_year,
    CASE WHEN event_type IN ('purchase', 'signup') THEN strftime(ts, '%B') END AS arrival_date_month,
    CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN k % 3 END AS INT) AS stays_in_weekend_nights,
    CAST(CASE WHEN event_type IN ('purchase', 'signup') AND user_id % 6 <> 0 THEN 1 + k % 7 END AS INT) AS stays_in_week_nights,
    CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 + user_id % 4 END AS INT) AS adults,
    CASE WHEN event_type IN ('purchase', 'signup') AND user_id % 5 <> 0 THEN 1.0 END AS children,
    CASE WHEN event_type IN ('purchase', 'signup') AND user_id % 7 <> 0 THEN 0 END AS babies,
    CASE WHEN event_type IN ('purchase', 'signup') OR event_type = 'click' THEN value END AS adr,
    CAST(CASE WHEN event_type = 'click' THEN k % 60 WHEN event_type IN ('purchase', 'signup') THEN 0 END AS INT) AS days_in_waiting_list,
    CAST(CASE WHEN event_type IN ('purchase', 'signup') OR event_type = 'view' THEN k % 6 END AS INT) AS total_of_special_requests,
    CAST(CASE WHEN event_type = 'view' THEN k % 4 WHEN event_type IN ('purchase', 'signup') THEN 0 END AS INT) AS booking_changes
  FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)) WHERE op IN ({ins})),
ud AS (SELECT seq, op, id FROM ch WHERE op IN ('update', 'delete')),
new AS (SELECT seq, (SELECT max(id) FROM bk) + row_number() OVER (ORDER BY seq) AS id FROM ch WHERE op = 'add'),
ex AS (SELECT ud.*, b.id IS NOT NULL AND (b.since IS NULL OR b.since < ud.seq) AS exists_
  FROM ud LEFT JOIN (SELECT id, NULL AS since FROM bk UNION ALL SELECT id, seq FROM new) b USING (id)),
fd AS (SELECT id, min(seq) AS del_seq FROM ex WHERE op = 'delete' AND exists_ GROUP BY id),
st AS (SELECT ex.seq, ex.op, ex.id, CASE WHEN ex.op = 'update' THEN ex.exists_ AND (fd.del_seq IS NULL OR ex.seq < fd.del_seq)
         ELSE ex.exists_ AND ex.seq = fd.del_seq END AS applied FROM ex LEFT JOIN fd USING (id)),
ap AS (SELECT ch.* FROM ch JOIN st ON ch.seq = st.seq WHERE st.applied),
fold AS (SELECT id, bool_or(op = 'delete') AS deleted,
""" + ",\n".join(
        f"    arg_max({c}, seq) FILTER (WHERE op = 'update' AND list_contains(changed_columns, '{c}')) AS {c}_v, "
        f"count(*) FILTER (WHERE op = 'update' AND list_contains(changed_columns, '{c}')) > 0 AS {c}_s"
        for c in _UPD_COLS) + """
  FROM ap GROUP BY id),
old AS (SELECT id, """ + _ROW_COLS + """ FROM bk UNION ALL SELECT new.id, """ + _ROW_COLS + """ FROM ch JOIN new USING (seq)),
snap AS (SELECT b.id, b.stays_in_weekend_nights, b.stays_in_week_nights, b.hotel, b.adults, b.children, b.babies,
""" + ",\n".join(f"    CASE WHEN f.{c}_s THEN f.{c}_v ELSE b.{c} END AS {c}" for c in _UPD_COLS) + """
  FROM old b LEFT JOIN fold f USING (id) WHERE NOT COALESCE(f.deleted, false))
"""


_ROW_COLS = ("hotel, stays_in_weekend_nights, stays_in_week_nights, adults, children, babies, adr, days_in_waiting_list, "
             "total_of_special_requests, booking_changes")
_UPD_COLS = ["adr", "days_in_waiting_list", "total_of_special_requests", "booking_changes"]

_SNAP_SELECT = """SELECT CAST(id AS BIGINT) AS id, hotel, ROUND(adr, 6) AS adr, days_in_waiting_list, total_of_special_requests,
  booking_changes, COALESCE(adults, 0) + COALESCE(children, 0) + COALESCE(babies, 0) AS total_guests,
  ROUND(COALESCE(adr, 0) * (COALESCE(stays_in_weekend_nights, 0) + COALESCE(stays_in_week_nights, 0)), 4) AS revenue,
  CASE WHEN days_in_waiting_list > -1 AND days_in_waiting_list <= 0 THEN 'No wait'
       WHEN days_in_waiting_list > 0 AND days_in_waiting_list <= 7 THEN '1-7 days'
       WHEN days_in_waiting_list > 7 AND days_in_waiting_list <= 30 THEN '8-30 days'
       WHEN days_in_waiting_list > 30 THEN 'Over 30 days' END AS waitlist_category,
  CAST(COALESCE(total_of_special_requests > 0, false) AS INT) AS has_special_requests FROM snap"""


def _snapshot(spark, sf_dir, ops) -> DataFrame:
    return _shown(A.apply_changes(bk(spark, sf_dir), change_feed(spark, sf_dir, ops), now=CHANGE_STAMP)["snapshot"])


def _shown(snapshot: DataFrame) -> DataFrame:
    snap = snapshot.select("id", "hotel", "adr", "days_in_waiting_list", "total_of_special_requests",
                                  "booking_changes", "total_guests", F.round("revenue", 4).alias("revenue"), "waitlist_category",
                                  "has_special_requests")
    return rounded(snap)


def _snap_sql(ops) -> str:
    return clean_ctes() + ", " + _feed_sql(ops) + _SNAP_SELECT


@register("apply_insert", _snap_sql(("add",)))
def q_apply_insert(spark, sf_dir):
    """A1 + A4: batch of inserts (ids above the high-water mark, totals derived)."""
    return _snapshot(spark, sf_dir, ("add",))


@register("apply_update", _snap_sql(("update",)))
def q_apply_update(spark, sf_dir):
    """A2: partial updates accumulated column by column; missing ids not applied."""
    return _snapshot(spark, sf_dir, ("update",))


@register("apply_delete", _snap_sql(("delete",)))
def q_apply_delete(spark, sf_dir):
    """A3: deletes by id; missing ids not applied."""
    return _snapshot(spark, sf_dir, ("delete",))


@register("apply_changes", _snap_sql(("add", "update", "delete")))
def q_apply_changes(spark, sf_dir):
    """A5: mixed ordered change feed -> new snapshot."""
    return _snapshot(spark, sf_dir, ("add", "update", "delete"))


#: Batches of the replayed feed; the table is compacted after COMPACT of them, so later ones are deltas on rewritten buckets.
BATCHES, COMPACT = 3, 2


def _replayed(spark, sf_dir) -> tuple[str, str]:
    """(table, base) after the feed has gone through the merge-on-read table in BATCHES runs of ``seq``, the last batch twice."""
    base, root = (shared_path(spark, f"feed-{n}-{uuid.uuid4().hex}") for n in ("base", "table"))
    bk(spark, sf_dir).write.parquet(base)
    feed = change_feed(spark, sf_dir)
    lo, hi = feed.agg(F.min("seq"), F.max("seq")).first()
    batch = F.least(F.floor((F.col("seq") - lo) * BATCHES / ((hi or 0) - (lo or 0) + 1)), F.lit(BATCHES - 1))
    for k in [*range(BATCHES), BATCHES - 1]:
        apply_batch(spark, root, base, feed.where(batch == k), k, CHANGE_STAMP, compact_after=COMPACT)
    return root, base


@register("change_table", _snap_sql(("add", "update", "delete")))
def q_change_table(spark, sf_dir):
    """T1 + A5: the feed replayed in three batches into a merge-on-read table (deltas, tombstones, one compaction)."""
    return _shown(latest_snapshot(spark, *_replayed(spark, sf_dir)))


@register("change_table_log", clean_ctes() + ", " + _feed_sql(("add", "update", "delete")) + """
SELECT CAST(st.seq AS BIGINT) AS id, CASE st.op WHEN 'add' THEN 'add_booking' WHEN 'update' THEN 'update_booking' ELSE 'delete_booking' END AS operation,
  CASE st.op WHEN 'add' THEN 'Added booking for Unknown' WHEN 'update' THEN 'Updated booking ID ' || CAST(st.id AS VARCHAR)
       ELSE 'Deleted booking ID ' || CAST(st.id AS VARCHAR) END AS details
FROM (SELECT seq, op, id, applied FROM st UNION ALL SELECT seq, op, id, true FROM ch WHERE op = 'add') st WHERE st.applied""")
def q_change_table_log(spark, sf_dir):
    """The whole log of the replayed feed; the batch that ran twice is there once."""
    return update_log(spark, _replayed(spark, sf_dir)[0]).select("id", "operation", "details")


@register("change_status", clean_ctes() + ", " + _feed_sql(("add", "update", "delete"))
          + "SELECT op, applied, CAST(count(*) AS BIGINT) AS n FROM (SELECT op, applied FROM st "
            "UNION ALL SELECT op, true FROM ch WHERE op = 'add') GROUP BY op, applied")
def q_change_status(spark, sf_dir):
    """A5: applied / not-applied counts per operation."""
    res = A.apply_changes(bk(spark, sf_dir), change_feed(spark, sf_dir), now=CHANGE_STAMP)
    return res["status"].groupBy("op", "applied").agg(F.count(F.lit(1)).alias("n"))


@register("db_stats_log", clean_ctes() + ", " + _feed_sql(("add", "update", "delete")) + """
SELECT CAST(count(*) AS BIGINT) AS total_bookings, CAST(count(*) FILTER (WHERE is_canceled = 1) AS BIGINT) AS canceled_bookings,
  ROUND(CAST(count(*) FILTER (WHERE is_canceled = 1) / count(*) AS DOUBLE), 6) AS cancellation_rate, CAST(count(DISTINCT country) AS BIGINT) AS distinct_countries, max(last_updated) AS last_update,
  CAST((SELECT count(*) FROM st WHERE applied) + (SELECT count(*) FROM ch WHERE op = 'add') AS BIGINT) AS total_updates FROM bk""")
def q_db_stats_log(spark, sf_dir):
    """Database statistics with the size of the update log."""
    rows = bk(spark, sf_dir)
    return rounded(M.db_stats(rows, A.apply_changes(rows, change_feed(spark, sf_dir), now=CHANGE_STAMP)["audit"]))


@register("update_log", clean_ctes() + ", " + _feed_sql(("add", "update", "delete")) + f"""
SELECT CAST(st.seq AS BIGINT) AS id, TIMESTAMP '{CHANGE_STAMP}' AS timestamp,
  CASE st.op WHEN 'add' THEN 'add_booking' WHEN 'update' THEN 'update_booking' ELSE 'delete_booking' END AS operation,
  CAST(1 AS BIGINT) AS record_count,
  CASE st.op WHEN 'add' THEN 'Added booking for Unknown' WHEN 'update' THEN 'Updated booking ID ' || CAST(st.id AS VARCHAR)
       ELSE 'Deleted booking ID ' || CAST(st.id AS VARCHAR) END AS details
FROM (SELECT seq, op, id, applied FROM st UNION ALL SELECT seq, op, id, true FROM ch WHERE op = 'add') st
WHERE st.applied ORDER BY st.seq DESC LIMIT 20""")
def q_update_log(spark, sf_dir):
    """S9 + L4: the 20 most recent audit rows of the applied change feed."""
    res = A.apply_changes(bk(spark, sf_dir), change_feed(spark, sf_dir), now=CHANGE_STAMP)
    return recent(res["audit"], 20, "timestamp", "id")

