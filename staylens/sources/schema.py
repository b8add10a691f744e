"""Booking schema and the vocabularies shared with the original service.

Everything under "Fixed values" must equal the original service's values for
results to agree (column names, category labels, bin edges, NULL tokens).
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

# Raw reservation columns in file order, with their storage types.
RAW_FIELDS: list[tuple[str, T.DataType]] = [
    ("hotel", T.StringType()),
    ("is_canceled", T.IntegerType()),
    ("lead_time", T.IntegerType()),
    ("arrival_date_year", T.IntegerType()),
    ("arrival_date_month", T.StringType()),
    ("arrival_date_week_number", T.IntegerType()),
    ("arrival_date_day_of_month", T.IntegerType()),
    ("stays_in_weekend_nights", T.IntegerType()),
    ("stays_in_week_nights", T.IntegerType()),
    ("adults", T.IntegerType()),
    ("children", T.DoubleType()),
    ("babies", T.IntegerType()),
    ("meal", T.StringType()),
    ("country", T.StringType()),
    ("market_segment", T.StringType()),
    ("distribution_channel", T.StringType()),
    ("is_repeated_guest", T.IntegerType()),
    ("previous_cancellations", T.IntegerType()),
    ("previous_bookings_not_canceled", T.IntegerType()),
    ("reserved_room_type", T.StringType()),
    ("assigned_room_type", T.StringType()),
    ("booking_changes", T.IntegerType()),
    ("deposit_type", T.StringType()),
    ("agent", T.DoubleType()),
    ("company", T.DoubleType()),
    ("days_in_waiting_list", T.IntegerType()),
    ("customer_type", T.StringType()),
    ("adr", T.DoubleType()),
    ("required_car_parking_spaces", T.IntegerType()),
    ("total_of_special_requests", T.IntegerType()),
    ("reservation_status", T.StringType()),
    ("reservation_status_date", T.StringType()),
]

# Text columns normalised to 'Unknown' when missing.
STRING_COLUMNS = [
    "hotel", "arrival_date_month", "meal", "country", "market_segment",
    "distribution_channel", "reserved_room_type", "assigned_room_type",
    "deposit_type", "customer_type", "reservation_status",
]

# Text values that stand for "missing" after a text conversion.
MISSING_TEXT = ["nan", "None"]

# Constant fills of the service (children, agent, company).
CONSTANT_FILLS = {"children": 0.0, "agent": -1.0, "company": -1.0}

# Flags that are stored as 0/1 integers.
INT_FLAGS = ["is_canceled", "is_repeated_guest"]

# Imputation: a numeric column with more distinct values than this gets the mean, else the mode.
MEAN_FILL_MIN_DISTINCT = 30

# Calendar month names, in calendar order.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# Waiting-list bins, right-closed: (-1,0] (0,7] (7,30] (30,inf).
WAITLIST_EDGES = [-1, 0, 7, 30]
WAITLIST_LABELS = ["No wait", "1-7 days", "8-30 days", "Over 30 days"]

# Lead-time bins, right-closed: (0,7] (7,30] (30,90] (90,180] (180,365] (365,inf).
LEAD_EDGES = [0, 7, 30, 90, 180, 365]
LEAD_LABELS = ["Last minute", "1 week to 1 month", "1-3 months", "3-6 months", "6-12 months", "Over 12 months"]

# Presence flags: new column <- source column (> 0).
PRESENCE_FLAGS = {
    "has_previous_stay": "previous_bookings_not_canceled",
    "has_previous_cancellations": "previous_cancellations",
    "has_booking_changes": "booking_changes",
    "requires_parking": "required_car_parking_spaces",
    "has_special_requests": "total_of_special_requests",
}

# Default NULL tokens of the CSV reader the service used (pandas read_csv defaults).
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --------------------------------------------------------------------------
# Derived schema
# --------------------------------------------------------------------------

RAW_COLUMNS = [name for name, _ in RAW_FIELDS]

RAW_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in RAW_FIELDS])

DERIVED_FIELDS: list[tuple[str, T.DataType]] = [
    ("total_nights", T.IntegerType()),
    ("total_guests", T.DoubleType()),
    ("revenue", T.DoubleType()),
    *[(flag, T.IntegerType()) for flag in PRESENCE_FLAGS],
    ("waitlist_category", T.StringType()),
    ("lead_time_category", T.StringType()),
    ("last_updated", T.TimestampType()),
]

# Stored table: id + raw columns + derived columns.
BOOKING_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False)]
    + [T.StructField(n, t, True) for n, t in RAW_FIELDS]
    + [T.StructField(n, t, True) for n, t in DERIVED_FIELDS]
)

UPDATE_LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("operation", T.StringType(), True),
    T.StructField("record_count", T.LongType(), True),
    T.StructField("details", T.StringType(), True),
])

QUERY_HISTORY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("query", T.StringType(), True),
    T.StructField("query_type", T.StringType(), True),
    T.StructField("response", T.StringType(), True),
    T.StructField("processing_time", T.DoubleType(), True),
])
