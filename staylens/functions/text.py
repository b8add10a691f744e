"""Text expressions: the per-booking description (C17) and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col_


def fixed2(c: str | Column) -> Column:
    """``%.2f`` formatting without thousands separators."""
    return F.format_string("%.2f", col_(c).cast("double"))


def py_str(c: str | Column) -> Column:
    """Text of a value as Python prints it: doubles keep ``.0``, NULL prints ``nan``."""
    return F.coalesce(col_(c).cast("string"), F.lit("nan"))


def py_number(c: str | Column) -> Column:
    """Text of a double as Python prints it: plain digits from 1e-4 to below 1e16, else ``5e-05``; NULL and NaN give NULL."""
    x = col_(c).cast("double")
    plain = F.rtrim(x.cast("decimal(38,20)").cast("string"), F.lit("0"))
    short = F.regexp_replace(x.cast("string"), r"(?:\.0)?E", "e")
    short = F.regexp_replace(F.regexp_replace(short, r"e(\d)", "e+$1"), r"([+-])(\d)$", "$10$2")
    size = F.abs(x)
    return (F.when(F.isnan(x), F.lit(None).cast("string"))
            .when((size >= 1e7) & (size < 1e16) | (size >= 1e-4) & (size < 1e-3), F.concat(plain, F.when(plain.endswith("."), F.lit("0")).otherwise(F.lit(""))))
            .when((size >= 1e-3) & (size < 1e7) | (size == 0) | (size == float("inf")), x.cast("string"))
            .otherwise(short))


def describe_booking() -> Column:
    """One English sentence block per booking, used as the text to encode.

    Fixed template (must equal the original service's wording).
    """
    status = F.when(F.col("is_canceled") == 1, F.lit("Cancelled")).otherwise(F.lit("Not cancelled"))
    status_date = F.coalesce(
        F.date_format(F.col("reservation_status_date").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit("NaT")
    )
    parts = [
        "A ", py_str("hotel"), " booking in ", py_str("arrival_date_month"), " ", py_str("arrival_date_year"),
        " for ", py_str("total_nights"), " nights with ", py_str("total_guests"), " guests. ",
        "Room type ", py_str("reserved_room_type"), " (assigned type ", py_str("assigned_room_type"), ") ",
        "at rate $", F.coalesce(fixed2("adr"), F.lit("nan")), " per night. ",
        "Customer from ", py_str("country"), " booked through ", py_str("market_segment"), " channel ",
        "with ", py_str("lead_time"), " days lead time. ",
        "Meal package: ", py_str("meal"), ". ",
        "Booking has ", py_str("booking_changes"), " changes and was on waitlist for ",
        py_str("days_in_waiting_list"), " days. ",
        "Customer has ", py_str("previous_bookings_not_canceled"), " previous stays and ",
        py_str("previous_cancellations"), " previous cancellations. ",
        "Requested ", py_str("required_car_parking_spaces"), " parking spaces and made ",
        py_str("total_of_special_requests"), " special requests. ",
        "Cancellation status: ", status, ". ",
        "Reservation status: ", py_str("reservation_status"), " as of ", status_date, ".",
    ]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
