"""Synthetic reservation source (S5), one booking per seed row, fully distributed.

Randomness is a seeded hash of (seed row key, field number), so the output does
not depend on partitioning or task retries (``rand()`` would change with the
partition layout). The derived columns come from ``operators.clean.derive``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Choice sets and ranges of the original generator
# --------------------------------------------------------------------------
HOTELS = ["Resort Hotel", "City Hotel"]
COUNTRIES = ["PRT", "GBR", "FRA", "ESP", "DEU", "ITA", "USA", "BRA", "NLD", "CHE", "BEL", "AUT", "CAN", "AUS"]
SEGMENTS = ["Direct", "Online TA", "Offline TA/TO", "Corporate", "Groups"]
CHANNELS = ["Direct", "TA/TO", "Corporate"]
ROOM_TYPES = ["A", "B", "C", "D", "E", "F", "G", "H"]
MEALS = ["BB", "HB", "FB", "SC"]
DEPOSITS = ["No Deposit", "Non Refund", "Refundable"]
CUSTOMER_TYPES = ["Transient", "Transient-Party", "Contract", "Group"]
CANCEL_P, REPEAT_P, SAME_ROOM_P, COMPANY_P = 0.3, 0.1, 0.8, 0.2
ADR_BASE = {"City Hotel": 80.0, "Resort Hotel": 100.0}


def _u(key: Column, seed: int, field: int) -> Column:
    """Uniform [0, 1) from a hash of (key, seed, field)."""
    h = F.xxhash64(key, F.lit(seed), F.lit(field))
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


def _int(key, seed, field, lo, hi) -> Column:
    """Uniform integer in [lo, hi]."""
    return (F.lit(lo) + F.floor(_u(key, seed, field) * (hi - lo + 1))).cast("int")


def _choice(key, seed, field, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), _int(key, seed, field, 1, len(values)))


def generate_bookings(seeds: DataFrame, key: str, seed: int = 42, year: int | None = None,
                      today: str | None = None) -> DataFrame:
    """One random raw booking per row of ``seeds`` (keyed by ``key``)."""
    from ..operators.clean import derive
    from ..sources.schema import MONTHS

    k = F.col(key).cast("long")
    today_c = F.current_date() if today is None else F.lit(today).cast("date")
    hotel = _choice(k, seed, 1, HOTELS)
    canceled = (_u(k, seed, 2) < CANCEL_P).cast("int")
    reserved = _choice(k, seed, 3, ROOM_TYPES)
    day = _int(k, seed, 4, 1, 28)
    adr_base = F.when(hotel == "City Hotel", F.lit(ADR_BASE["City Hotel"])).otherwise(F.lit(ADR_BASE["Resort Hotel"]))
    raw = seeds.select(
        k.alias("id"),
        hotel.alias("hotel"),
        canceled.alias("is_canceled"),
        _int(k, seed, 5, 1, 365).alias("lead_time"),
        (F.year(today_c) if year is None else F.lit(year)).cast("int").alias("arrival_date_year"),
        _choice(k, seed, 6, MONTHS).alias("arrival_date_month"),
        (F.floor(day / 7) + 1).cast("int").alias("arrival_date_week_number"),
        day.alias("arrival_date_day_of_month"),
        _int(k, seed, 7, 0, 3).alias("stays_in_weekend_nights"),
        _int(k, seed, 8, 1, 7).alias("stays_in_week_nights"),
        _int(k, seed, 9, 1, 4).alias("adults"),
        _int(k, seed, 10, 0, 2).cast("double").alias("children"),
        _int(k, seed, 11, 0, 1).alias("babies"),
        _choice(k, seed, 12, MEALS).alias("meal"),
        _choice(k, seed, 13, COUNTRIES).alias("country"),
        _choice(k, seed, 14, SEGMENTS).alias("market_segment"),
        _choice(k, seed, 15, CHANNELS).alias("distribution_channel"),
        (_u(k, seed, 16) < REPEAT_P).cast("int").alias("is_repeated_guest"),
        _int(k, seed, 17, 0, 2).alias("previous_cancellations"),
        _int(k, seed, 18, 0, 3).alias("previous_bookings_not_canceled"),
        reserved.alias("reserved_room_type"),
        F.when(_u(k, seed, 19) < SAME_ROOM_P, reserved).otherwise(_choice(k, seed, 20, ROOM_TYPES)).alias("assigned_room_type"),
        _int(k, seed, 21, 0, 3).alias("booking_changes"),
        _choice(k, seed, 22, DEPOSITS).alias("deposit_type"),
        _int(k, seed, 23, 1, 300).cast("double").alias("agent"),
        F.when(_u(k, seed, 24) < COMPANY_P, _int(k, seed, 25, 1, 200).cast("double")).otherwise(F.lit(-1.0)).alias("company"),
        _int(k, seed, 26, 0, 50).alias("days_in_waiting_list"),
        _choice(k, seed, 27, CUSTOMER_TYPES).alias("customer_type"),
        (adr_base * (F.lit(0.5) + _u(k, seed, 28) * 1.5)).alias("adr"),
        _int(k, seed, 29, 0, 2).alias("required_car_parking_spaces"),
        _int(k, seed, 30, 0, 5).alias("total_of_special_requests"),
        F.when(canceled == 1, F.lit("Canceled")).otherwise(F.lit("Check-Out")).alias("reservation_status"),
        F.date_format(F.date_sub(today_c, _int(k, seed, 31, 1, 30)), "yyyy-MM-dd").alias("reservation_status_date"),
    )
    return derive(raw)
