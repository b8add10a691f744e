"""DuckDB oracle building blocks: the bookings view and the cleaning steps in SQL.

These strings are the independent check of the Spark operators: the same
semantics written as plain SQL for DuckDB over the driver's parquet views.
"""

from __future__ import annotations

from ..sources.schema import (
    LEAD_EDGES, LEAD_LABELS, MISSING_TEXT, PRESENCE_FLAGS, RAW_COLUMNS, STRING_COLUMNS,
    WAITLIST_EDGES, WAITLIST_LABELS,
)
from ..sources.tables import bookings_view_sql

STAMP = "2024-01-01 00:00:00"  # fixed ``last_updated`` used by the registered queries


def _norm(c: str) -> str:
    toks = ", ".join(f"'{t}'" for t in MISSING_TEXT)
    return f"CASE WHEN {c} IS NULL OR {c} IN ({toks}) THEN 'Unknown' ELSE {c} END AS {c}"


def _bins(c: str, edges: list, labels: list, open_top: bool = True) -> str:
    uppers = edges[1:] + ([None] if open_top else [])
    arms = []
    for lo, hi, lab in zip(edges, uppers, labels):
        cond = f"{c} > {lo}" if hi is None else f"{c} > {lo} AND {c} <= {hi}"
        arms.append(f"WHEN {cond} THEN '{lab}'")
    return "CASE " + " ".join(arms) + " END"


def _filled_select() -> str:
    cols = ["id"]
    for c in RAW_COLUMNS[:4] + ["arrival_month_no"] + RAW_COLUMNS[4:]:
        if c in STRING_COLUMNS:
            cols.append(_norm(c))
        elif c == "children":
            cols.append("COALESCE(children, 0.0) AS children")
        elif c in ("agent", "company"):
            cols.append(f"COALESCE({c}, -1.0) AS {c}")
        elif c in ("is_canceled", "is_repeated_guest"):
            cols.append(f"CAST({c} AS INT) AS {c}")
        else:
            cols.append(c)
    return "SELECT " + ", ".join(cols) + " FROM bookings"


def clean_ctes() -> str:
    """``WITH bookings AS (...), filled, imputed, bk`` — ``bk`` is the cleaned table."""
    flags = ", ".join(
        f"CAST(COALESCE({src} > 0, false) AS INT) AS {flag}" for flag, src in PRESENCE_FLAGS.items()
    )
    return f"""WITH bookings AS ({bookings_view_sql()}),
filled AS ({_filled_select()}),
imputed AS (
  SELECT * REPLACE (COALESCE(adr, CASE WHEN (SELECT count(DISTINCT adr) FROM filled) > 30
      THEN (SELECT avg(adr) FROM filled)
      ELSE (SELECT adr FROM filled WHERE adr IS NOT NULL GROUP BY adr ORDER BY count(*) DESC, adr LIMIT 1) END) AS adr)
  FROM filled),
bk AS (
  SELECT * REPLACE (TRY_CAST(TRY_STRPTIME(reservation_status_date, '%Y-%m-%d') AS DATE) AS reservation_status_date),
    CAST(stays_in_weekend_nights + stays_in_week_nights AS INT) AS total_nights,
    CAST(adults + children + babies AS DOUBLE) AS total_guests,
    CAST(adr * (stays_in_weekend_nights + stays_in_week_nights) AS DOUBLE) AS revenue,
    {flags},
    {_bins('days_in_waiting_list', WAITLIST_EDGES, WAITLIST_LABELS)} AS waitlist_category,
    {_bins('lead_time', LEAD_EDGES, LEAD_LABELS)} AS lead_time_category,
    TIMESTAMP '{STAMP}' AS last_updated
  FROM imputed)
"""


def on_bk(select_sql: str) -> str:
    """A full oracle statement: cleaning CTEs followed by ``select_sql`` over ``bk``."""
    return clean_ctes() + select_sql
