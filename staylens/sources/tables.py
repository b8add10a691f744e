"""Readers for the driver's parquet tables and the ``bookings`` stand-in view.

The stand-in view only reshapes ``orders``/``customer``/``nation`` rows into the
reservation schema; it does none of the engine's work. The same SQL text runs
on Spark (DataFrame placeholders) and on DuckDB (table names), so the oracle
sees identical input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame (parquet scan; pruning/pushdown by Catalyst)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BOOKINGS_VIEW_SQL = """
SELECT CAST(o_orderkey AS BIGINT) AS id,
  CASE WHEN o_custkey % 3 = 0 THEN 'Resort Hotel' ELSE 'City Hotel' END AS hotel,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_canceled,
  CAST((o_orderkey * 7) % 738 AS INT) AS lead_time,
  CAST(year(o_orderdate) AS INT) AS arrival_date_year,
  CAST(month(o_orderdate) AS INT) AS arrival_month_no,
  CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April'
    WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September'
    WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS arrival_date_month,
  CAST(weekofyear(o_orderdate) AS INT) AS arrival_date_week_number,
  CAST(day(o_orderdate) AS INT) AS arrival_date_day_of_month,
  CAST(o_orderkey % 3 AS INT) AS stays_in_weekend_nights,
  CAST(o_orderkey % 8 AS INT) AS stays_in_week_nights,
  CAST(1 + o_custkey % 3 AS INT) AS adults,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS DOUBLE) END AS children,
  CASE WHEN o_custkey % 20 = 0 THEN 1 ELSE 0 END AS babies,
  CASE o_orderkey % 5 WHEN 0 THEN 'HB' WHEN 1 THEN 'FB' WHEN 2 THEN 'SC' ELSE 'BB' END AS meal,
  CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE n_name END AS country,
  c_mktsegment AS market_segment, o_orderpriority AS distribution_channel,
  CASE WHEN o_custkey % 31 = 0 THEN 1 ELSE 0 END AS is_repeated_guest,
  CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS previous_cancellations,
  CAST(o_custkey % 5 AS INT) AS previous_bookings_not_canceled,
  substr('ABCDEFGH', CAST(o_orderkey % 8 AS INT) + 1, 1) AS reserved_room_type,
  substr('ABCDEFGH', CAST((CASE WHEN o_custkey % 5 = 0 THEN o_custkey ELSE o_orderkey END) % 8 AS INT) + 1, 1) AS assigned_room_type,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_custkey % 4 AS INT) ELSE 0 END AS booking_changes,
  CASE o_orderkey % 5 WHEN 3 THEN 'Non Refund' WHEN 4 THEN 'Refundable' ELSE 'No Deposit' END AS deposit_type,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 300 AS DOUBLE) END AS agent,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_custkey % 200 AS DOUBLE) END AS company,
  CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_custkey % 60 AS INT) ELSE 0 END AS days_in_waiting_list,
  CASE o_custkey % 4 WHEN 0 THEN 'Transient' WHEN 1 THEN 'Transient-Party' WHEN 2 THEN 'Contract' ELSE 'Group' END AS customer_type,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice / 10) AS BIGINT) AS DOUBLE) / CAST(100 AS DOUBLE) END AS adr,
  CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS required_car_parking_spaces,
  CAST(o_custkey % 6 AS INT) AS total_of_special_requests,
  CASE WHEN o_orderstatus <> 'F' THEN 'Check-Out' WHEN o_orderkey % 10 = 0 THEN 'No-Show' ELSE 'Canceled' END AS reservation_status,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS reservation_status_date
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""


def bookings_view_sql(orders: str = "orders", customer: str = "customer", nation: str = "nation") -> str:
    """The view text with plain table names (DuckDB form)."""
    return BOOKINGS_VIEW_SQL.format(orders=orders, customer=customer, nation=nation)


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reservation rows (stand-in for the CSV) built from the driver's tables."""
    cols_o = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return spark.sql(
        BOOKINGS_VIEW_SQL,
        orders=read_table(spark, sf_dir, "orders").select(*cols_o),
        customer=read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"),
        nation=read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
    )
