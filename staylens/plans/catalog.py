"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the driver's whole tables and
returns a lazy DataFrame. Double columns are rounded (money 2 digits, ratios
and means 6) on both sides so that summation order cannot flip a hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean as C
from ..operators import metrics as M
from ..operators.filters import filter_bookings
from ..session import shared_path
from ..sources.tables import bookings, bookings_view_sql
from .sqltext import STAMP, on_bk


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle, (fn.__doc__ or "").strip())
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6, money: tuple[str, ...] = ()) -> DataFrame:
    """Round every DOUBLE column (``money`` columns to 2 digits)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out.append(F.round(F.col(f.name), 2 if f.name in money else digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned bookings (C2-C15) over the stand-in view, with a fixed stamp."""
    return C.clean(bookings(spark, sf_dir), now=STAMP)


def bk_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bk`` from a stored copy of the view's rows, for queries that read the bookings many times: the view's join runs once."""
    return C.clean_staged(bookings(spark, sf_dir), shared_path(spark, f"bookings-{uuid.uuid4().hex}"), now=STAMP)


def r6(x: str) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), 6)"


def r2(x: str) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), 2)"


# --------------------------------------------------------------------------
# Sources and cleaning
# --------------------------------------------------------------------------

@register("sample_n", on_bk(f"SELECT id, hotel, arrival_date_year, {r6('adr')} AS adr FROM bk ORDER BY md5(id || ' 42'), id LIMIT 2500"))
def q_sample_n(spark, sf_dir):
    """Repeatable fixed-size sample (2,500 rows, seed 42) of the cleaned bookings."""
    return rounded(C.sample_n(bk(spark, sf_dir), 2500, 42).select("id", "hotel", "arrival_date_year", "adr"))


_RAW_VIEW_COLS = ["id", "hotel", "is_canceled", "lead_time", "arrival_date_year", "arrival_month_no",
                  "arrival_date_month", "arrival_date_week_number", "arrival_date_day_of_month",
                  "stays_in_weekend_nights", "stays_in_week_nights", "adults", "children", "babies", "meal",
                  "country", "market_segment", "distribution_channel", "is_repeated_guest",
                  "previous_cancellations", "previous_bookings_not_canceled", "reserved_room_type",
                  "assigned_room_type", "booking_changes", "deposit_type", "agent", "company",
                  "days_in_waiting_list", "customer_type", "adr", "required_car_parking_spaces",
                  "total_of_special_requests", "reservation_status", "reservation_status_date"]


@register("null_counts", on_bk("SELECT " + ", ".join(
    f"CAST(count(*) - count({c}) AS BIGINT) AS {c}" for c in _RAW_VIEW_COLS) + " FROM bookings"))
def q_null_counts(spark, sf_dir):
    """NULLs per column of the raw bookings."""
    return C.null_counts(bookings(spark, sf_dir))


@register("clean_fill", on_bk(
    "SELECT id, children, agent, company, country, hotel, meal, is_canceled, is_repeated_guest, "
    "reservation_status FROM filled"))
def q_clean_fill(spark, sf_dir):
    """Constant fills, integer flags, text normalisation."""
    df = C.normalise_strings(C.cast_flags(C.fill_constants(bookings(spark, sf_dir))))
    return df.select("id", "children", "agent", "company", "country", "hotel", "meal", "is_canceled",
                     "is_repeated_guest", "reservation_status")


@register("clean_notebook", on_bk(
    "SELECT id, COALESCE(CAST(agent AS VARCHAR), 'None') AS agent, COALESCE(CAST(company AS VARCHAR), 'None') AS company, "
    "CASE WHEN COALESCE(country, 'Unknown') = 'EST' THEN 'ESTO' ELSE COALESCE(country, 'Unknown') END AS country, "
    "COALESCE(children, 0.0) AS children FROM bookings"))
def q_clean_notebook(spark, sf_dir):
    """Notebook fill style (agent/company -> 'None' text, country -> 'Unknown', EST -> ESTO)."""
    df = C.fill_constants(bookings(spark, sf_dir), style="notebook")
    return df.select("id", "agent", "company", "country", "children")


@register("impute", on_bk(f"SELECT id, {r6('adr')} AS adr, country, children FROM imputed"))
def q_impute(spark, sf_dir):
    """Data-dependent imputation (mean for >30 distinct numeric values, else mode)."""
    df = C.impute(C.normalise_strings(C.cast_flags(C.fill_constants(bookings(spark, sf_dir)))))
    return rounded(df.select("id", "adr", "country", "children"))


@register("derive_totals", on_bk(
    f"SELECT id, total_nights, total_guests, {r6('revenue')} AS revenue, reservation_status_date FROM bk"))
def q_derive_totals(spark, sf_dir):
    """Parsed status date, total nights, total guests, revenue."""
    return rounded(bk(spark, sf_dir).select("id", "total_nights", "total_guests", "revenue",
                                            "reservation_status_date"))


@register("flags", on_bk(
    "SELECT id, has_previous_stay, has_previous_cancellations, has_booking_changes, requires_parking, "
    "has_special_requests FROM bk"))
def q_flags(spark, sf_dir):
    """Five presence flags."""
    return bk(spark, sf_dir).select("id", "has_previous_stay", "has_previous_cancellations",
                                    "has_booking_changes", "requires_parking", "has_special_requests")


@register("waitlist_bins", on_bk("SELECT id, days_in_waiting_list, waitlist_category FROM bk"))
def q_waitlist_bins(spark, sf_dir):
    """Right-closed waiting-list bins."""
    return bk(spark, sf_dir).select("id", "days_in_waiting_list", "waitlist_category")


@register("lead_bins", on_bk("SELECT id, lead_time, lead_time_category FROM bk"))
def q_lead_bins(spark, sf_dir):
    """C14: right-closed lead-time bins (lead time 0 -> NULL)."""
    return bk(spark, sf_dir).select("id", "lead_time", "lead_time_category")


def describe_sql(name: str) -> str:
    """The description sentence of each booking as SQL over ``bk``."""
    return """SELECT id, concat(
  'A ', hotel, ' booking in ', arrival_date_month, ' ', CAST(arrival_date_year AS VARCHAR),
  ' for ', CAST(total_nights AS VARCHAR), ' nights with ', CAST(total_guests AS VARCHAR), ' guests. ',
  'Room type ', reserved_room_type, ' (assigned type ', assigned_room_type, ') ',
  'at rate $', printf('%.2f', adr), ' per night. ',
  'Customer from ', country, ' booked through ', market_segment, ' channel ',
  'with ', CAST(lead_time AS VARCHAR), ' days lead time. ',
  'Meal package: ', meal, '. ',
  'Booking has ', CAST(booking_changes AS VARCHAR), ' changes and was on waitlist for ',
  CAST(days_in_waiting_list AS VARCHAR), ' days. ',
  'Customer has ', CAST(previous_bookings_not_canceled AS VARCHAR), ' previous stays and ',
  CAST(previous_cancellations AS VARCHAR), ' previous cancellations. ',
  'Requested ', CAST(required_car_parking_spaces AS VARCHAR), ' parking spaces and made ',
  CAST(total_of_special_requests AS VARCHAR), ' special requests. ',
  'Cancellation status: ', CASE WHEN is_canceled = 1 THEN 'Cancelled' ELSE 'Not cancelled' END, '. ',
  'Reservation status: ', reservation_status, ' as of ',
  COALESCE(strftime(CAST(reservation_status_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S'), 'NaT'), '.'
) AS """ + name + " FROM bk"


@register("describe_text", on_bk(describe_sql("description")))
def q_describe_text(spark, sf_dir):
    """C17: description sentence per booking (input of the text encoder)."""
    return C.describe(bk(spark, sf_dir))


# --------------------------------------------------------------------------
# Structured filters
# --------------------------------------------------------------------------

@register("filter_eq", on_bk(
    "SELECT id, hotel, arrival_date_year, arrival_date_month, is_canceled FROM bk "
    "WHERE hotel = 'Resort Hotel' AND is_canceled = 1"))
def q_filter_eq(spark, sf_dir):
    """equality conditions AND-ed ({hotel: Resort Hotel, is_canceled: 1})."""
    out = filter_bookings(bk(spark, sf_dir), {"hotel": "Resort Hotel", "is_canceled": 1})
    return out.select("id", "hotel", "arrival_date_year", "arrival_date_month", "is_canceled")


@register("filter_cmp", on_bk(
    "SELECT id, lead_time, total_of_special_requests, ROUND(adr, 6) AS adr FROM bk "
    "WHERE total_of_special_requests > 0 AND lead_time > 30 AND lead_time < 200 AND arrival_date_year = 1997"))
def q_filter_cmp(spark, sf_dir):
    """comparison conditions (gt/lt/eq, all AND-ed) mixed with equality."""
    conds = {"total_of_special_requests": {"gt": 0}, "lead_time": {"gt": 30, "lt": 200},
             "arrival_date_year": {"eq": 1997}}
    return rounded(filter_bookings(bk(spark, sf_dir), conds).select(
        "id", "lead_time", "total_of_special_requests", "adr"))


@register("filter_month_year", on_bk(
    f"SELECT hotel, CAST(count(*) AS BIGINT) AS bookings, CAST(sum(is_canceled) AS BIGINT) AS canceled, "
    f"{r2('sum(revenue)')} AS revenue, {r6('avg(adr)')} AS avg_adr FROM bk "
    "WHERE arrival_date_year = 1997 AND arrival_date_month = 'July' GROUP BY hotel"))
def q_filter_month_year(spark, sf_dir):
    """F19 + M3/M5/M7 by hotel: July 1997 bookings, cancellations, revenue, mean price."""
    df = filter_bookings(bk(spark, sf_dir), {"arrival_date_year": 1997, "arrival_date_month": "July"})
    out = df.groupBy("hotel").agg(
        F.count(F.lit(1)).alias("bookings"), F.sum("is_canceled").cast("long").alias("canceled"),
        F.sum("revenue").alias("revenue"), F.avg("adr").alias("avg_adr"))
    return rounded(out, money=("revenue",))


# --------------------------------------------------------------------------
# Metric menu
# --------------------------------------------------------------------------

def _scalar_sql(cols: list[tuple[str, str]]) -> str:
    return on_bk("SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in cols) + " FROM bk")


@register("records", _scalar_sql([("total_records", "CAST(count(*) AS BIGINT)")]))
def q_records(spark, sf_dir):
    """M1: record count."""
    return M.records(bk(spark, sf_dir))


@register("hotel_distribution", on_bk(
    "SELECT hotel, CAST(count(*) AS BIGINT) AS n FROM bk WHERE hotel IS NOT NULL GROUP BY hotel"))
def q_hotel_distribution(spark, sf_dir):
    """M2: bookings per hotel."""
    return M.hotel_distribution(bk(spark, sf_dir))


@register("revenue_totals", _scalar_sql([
    ("total_revenue", r2("COALESCE(sum(revenue), 0)")), ("avg_revenue", r6("avg(revenue)"))]))
def q_revenue_totals(spark, sf_dir):
    """M3: total and mean revenue."""
    return rounded(M.revenue_totals(bk(spark, sf_dir)), money=("total_revenue",))


@register("revenue_by_hotel", on_bk(
    f"SELECT hotel, {r2('COALESCE(sum(revenue), 0)')} AS total_revenue FROM bk WHERE hotel IS NOT NULL GROUP BY hotel"))
def q_revenue_by_hotel(spark, sf_dir):
    """M4: revenue per hotel."""
    return rounded(M.revenue_by_hotel(bk(spark, sf_dir)), money=("total_revenue",))


@register("cancellation", _scalar_sql([
    ("total_bookings", "CAST(count(*) AS BIGINT)"),
    ("canceled_bookings", "CAST(COALESCE(sum(is_canceled), 0) AS BIGINT)"),
    ("cancellation_rate", r6("COALESCE(sum(is_canceled), 0) / count(*)"))]))
def q_cancellation(spark, sf_dir):
    """M5: bookings, cancellations, cancellation rate."""
    return rounded(M.cancellation(bk(spark, sf_dir)))


@register("cancellation_by_country", on_bk(
    "SELECT country, canceled, bookings, ROUND(CAST(canceled AS DOUBLE) / bookings, 6) AS rate FROM ("
    "SELECT country, CAST(COALESCE(sum(is_canceled), 0) AS BIGINT) AS canceled, CAST(count(is_canceled) AS BIGINT) AS bookings "
    "FROM bk WHERE country IS NOT NULL GROUP BY country) ORDER BY canceled DESC, country LIMIT 10"))
def q_cancellation_by_country(spark, sf_dir):
    """M6: cancellations per country, top 10 by cancelled count."""
    return rounded(M.cancellation_by_country(bk(spark, sf_dir)))


@register("price_stats", _scalar_sql([
    ("avg_price", r6("avg(adr)")), ("median_price", r6("quantile_cont(adr, 0.5)")),
    ("min_price", r6("min(adr)")), ("max_price", r6("max(adr)"))]))
def q_price_stats(spark, sf_dir):
    """M7: mean, exact median, min, max of the daily rate."""
    return rounded(M.price_stats(bk(spark, sf_dir)))


@register("adr_by_hotel", on_bk(
    f"SELECT hotel, {r6('avg(adr)')} AS avg_adr FROM bk WHERE hotel IS NOT NULL GROUP BY hotel"))
def q_adr_by_hotel(spark, sf_dir):
    """M8: mean daily rate per hotel."""
    return rounded(M.adr_by_hotel(bk(spark, sf_dir)))


_MONTH_DIM = ("(SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {i + 1})" for i, m in enumerate(
        ["January", "February", "March", "April", "May", "June", "July", "August", "September",
         "October", "November", "December"])) + ") AS t(arrival_date_month, arrival_date_month_order))")


@register("bookings_by_month", on_bk(
    f"SELECT d.arrival_date_month, CAST(d.arrival_date_month_order AS INT) AS arrival_date_month_order, "
    f"CAST(c.bookings AS BIGINT) AS bookings FROM {_MONTH_DIM} d LEFT JOIN "
    "(SELECT arrival_date_month, count(is_canceled) AS bookings FROM bk WHERE arrival_date_month IS NOT NULL "
    "GROUP BY arrival_date_month) c USING (arrival_date_month)"))
def q_bookings_by_month(spark, sf_dir):
    """M9: bookings per calendar month, all twelve months listed (absent -> NULL)."""
    return M.bookings_by_month(bk(spark, sf_dir))


@register("revenue_by_month", on_bk(
    f"SELECT d.arrival_date_month, CAST(d.arrival_date_month_order AS INT) AS arrival_date_month_order, "
    f"ROUND(c.revenue, 2) AS revenue FROM {_MONTH_DIM} d LEFT JOIN "
    "(SELECT arrival_date_month, CAST(COALESCE(sum(revenue), 0) AS DOUBLE) AS revenue FROM bk "
    "WHERE arrival_date_month IS NOT NULL GROUP BY arrival_date_month) c USING (arrival_date_month)"))
def q_revenue_by_month(spark, sf_dir):
    """Revenue per calendar month."""
    return rounded(M.revenue_by_month(bk(spark, sf_dir)), money=("revenue",))


@register("guests", _scalar_sql([("avg_guests_per_booking", r6("avg(total_guests)"))]))
def q_guests(spark, sf_dir):
    """Mean guests per booking."""
    return rounded(M.guests(bk(spark, sf_dir)))


@register("guests_by_segment", on_bk(
    f"SELECT market_segment, {r6('COALESCE(sum(total_guests), 0)')} AS total_guests FROM bk "
    "WHERE market_segment IS NOT NULL GROUP BY market_segment"))
def q_guests_by_segment(spark, sf_dir):
    """Guests per market segment."""
    return rounded(M.guests_by_segment(bk(spark, sf_dir)))


@register("lead_stats", _scalar_sql([
    ("avg_lead_time", r6("avg(lead_time)")), ("median_lead_time", r6("quantile_cont(lead_time, 0.5)"))]))
def q_lead_stats(spark, sf_dir):
    """Mean and median lead time."""
    return rounded(M.lead_stats(bk(spark, sf_dir)))


@register("lead_distribution", on_bk(
    "SELECT lead_time_category, CAST(count(*) AS BIGINT) AS n FROM bk WHERE lead_time_category IS NOT NULL "
    "GROUP BY lead_time_category"))
def q_lead_distribution(spark, sf_dir):
    """Bookings per lead-time bin."""
    return M.lead_distribution(bk(spark, sf_dir))


@register("lead_by_hotel", on_bk(
    f"SELECT hotel, {r6('avg(lead_time)')} AS avg_lead_time FROM bk WHERE hotel IS NOT NULL GROUP BY hotel"))
def q_lead_by_hotel(spark, sf_dir):
    """Mean lead time per hotel."""
    return rounded(M.lead_by_hotel(bk(spark, sf_dir)))


@register("repeat_guests", _scalar_sql([
    ("repeat_guests", "CAST(COALESCE(sum(is_repeated_guest), 0) AS BIGINT)"),
    ("repeat_rate", r6("COALESCE(sum(is_repeated_guest), 0) / count(*)")),
    ("avg_previous_stays", r6("avg(previous_bookings_not_canceled)")),
    ("avg_previous_cancellations", r6("avg(previous_cancellations)"))]))
def q_repeat_guests(spark, sf_dir):
    """Repeat guests, rate, previous stays and cancellations."""
    return rounded(M.repeat_guests(bk(spark, sf_dir)))


@register("room_distribution", on_bk(
    "SELECT reserved_room_type, CAST(count(*) AS BIGINT) AS n FROM bk WHERE reserved_room_type IS NOT NULL "
    "GROUP BY reserved_room_type"))
def q_room_distribution(spark, sf_dir):
    """Bookings per reserved room type."""
    return M.room_distribution(bk(spark, sf_dir))


@register("room_change", _scalar_sql([
    ("room_change_rate", r6("avg(CASE WHEN reserved_room_type IS NOT DISTINCT FROM assigned_room_type "
                            "THEN 0 ELSE 1 END)"))]))
def q_room_change(spark, sf_dir):
    """Share of bookings whose assigned room differs from the reserved one."""
    return rounded(M.room_change(bk(spark, sf_dir)))


@register("booking_changes", _scalar_sql([
    ("bookings_with_changes", "CAST(count(*) FILTER (WHERE booking_changes > 0) AS BIGINT)"),
    ("change_rate", r6("count(*) FILTER (WHERE booking_changes > 0) / count(*)")),
    ("avg_changes", r6("avg(booking_changes)"))]))
def q_booking_changes(spark, sf_dir):
    """Bookings with changes, rate, mean changes."""
    return rounded(M.booking_changes(bk(spark, sf_dir)))


@register("special_requests", _scalar_sql([
    ("bookings_with_requests", "CAST(count(*) FILTER (WHERE total_of_special_requests > 0) AS BIGINT)"),
    ("request_rate", r6("count(*) FILTER (WHERE total_of_special_requests > 0) / count(*)")),
    ("avg_requests", r6("avg(total_of_special_requests)"))]))
def q_special_requests(spark, sf_dir):
    """Bookings with special requests, rate, mean requests."""
    return rounded(M.special_requests(bk(spark, sf_dir)))


@register("waitlist", _scalar_sql([
    ("bookings_waitlisted", "CAST(count(*) FILTER (WHERE days_in_waiting_list > 0) AS BIGINT)"),
    ("waitlist_rate", r6("count(*) FILTER (WHERE days_in_waiting_list > 0) / count(*)")),
    ("avg_waitlist_days", r6("avg(days_in_waiting_list)"))]))
def q_waitlist(spark, sf_dir):
    """Waitlisted bookings, rate, mean days waiting."""
    return rounded(M.waitlist(bk(spark, sf_dir)))


_WAIT_DIM = ("(SELECT * FROM (VALUES ('No wait', 1), ('1-7 days', 2), ('8-30 days', 3), ('Over 30 days', 4)) "
             "AS t(waitlist_category, waitlist_category_order))")


@register("waitlist_distribution", on_bk(
    f"SELECT d.waitlist_category, CAST(d.waitlist_category_order AS INT) AS waitlist_category_order, "
    f"CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM {_WAIT_DIM} d LEFT JOIN "
    "(SELECT waitlist_category, count(*) AS n FROM bk WHERE waitlist_category IS NOT NULL GROUP BY 1) c "
    "USING (waitlist_category)"))
def q_waitlist_distribution(spark, sf_dir):
    """Bookings per waiting-list bin, empty bins listed with 0."""
    return M.waitlist_distribution(bk(spark, sf_dir))


@register("meal_distribution", on_bk(
    "SELECT meal, CAST(count(*) AS BIGINT) AS n FROM bk WHERE meal IS NOT NULL GROUP BY meal"))
def q_meal_distribution(spark, sf_dir):
    """Bookings per meal plan."""
    return M.meal_distribution(bk(spark, sf_dir))


@register("meal_by_country", on_bk(
    "SELECT t.country, m.meal, CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM "
    "(SELECT country, count(*) AS total FROM bk WHERE country IS NOT NULL AND meal IS NOT NULL GROUP BY country "
    " ORDER BY total DESC, country LIMIT 5) t "
    "CROSS JOIN (SELECT DISTINCT meal FROM bk WHERE meal IS NOT NULL AND country IS NOT NULL) m "
    "LEFT JOIN (SELECT country, meal, count(*) AS n FROM bk GROUP BY country, meal) c "
    "ON c.country = t.country AND c.meal = m.meal"))
def q_meal_by_country(spark, sf_dir):
    """Meal counts for the five busiest countries (empty cells 0)."""
    return M.meal_by_country(bk(spark, sf_dir))


@register("channel_distribution", on_bk(
    "SELECT distribution_channel, CAST(count(*) AS BIGINT) AS n FROM bk WHERE distribution_channel IS NOT NULL "
    "GROUP BY distribution_channel"))
def q_channel_distribution(spark, sf_dir):
    """Bookings per distribution channel."""
    return M.channel_distribution(bk(spark, sf_dir))


@register("segment_distribution", on_bk(
    "SELECT market_segment, CAST(count(*) AS BIGINT) AS n FROM bk WHERE market_segment IS NOT NULL "
    "GROUP BY market_segment"))
def q_segment_distribution(spark, sf_dir):
    """Bookings per market segment."""
    return M.segment_distribution(bk(spark, sf_dir))


@register("revenue_by_channel", on_bk(
    f"SELECT distribution_channel, {r2('COALESCE(sum(revenue), 0)')} AS revenue FROM bk "
    "WHERE distribution_channel IS NOT NULL GROUP BY distribution_channel"))
def q_revenue_by_channel(spark, sf_dir):
    """Revenue per distribution channel."""
    return rounded(M.revenue_by_channel(bk(spark, sf_dir)), money=("revenue",))


@register("revenue_by_segment", on_bk(
    f"SELECT market_segment, {r2('COALESCE(sum(revenue), 0)')} AS revenue FROM bk "
    "WHERE market_segment IS NOT NULL GROUP BY market_segment"))
def q_revenue_by_segment(spark, sf_dir):
    """Revenue per market segment."""
    return rounded(M.revenue_by_segment(bk(spark, sf_dir)), money=("revenue",))


@register("deposit_distribution", on_bk(
    "SELECT deposit_type, CAST(count(*) AS BIGINT) AS n FROM bk WHERE deposit_type IS NOT NULL GROUP BY deposit_type"))
def q_deposit_distribution(spark, sf_dir):
    """Bookings per deposit type."""
    return M.deposit_distribution(bk(spark, sf_dir))


@register("cancellation_by_deposit", on_bk(
    "SELECT deposit_type, canceled, bookings, ROUND(CAST(canceled AS DOUBLE) / bookings, 6) AS rate FROM ("
    "SELECT deposit_type, CAST(COALESCE(sum(is_canceled), 0) AS BIGINT) AS canceled, "
    "CAST(count(is_canceled) AS BIGINT) AS bookings FROM bk WHERE deposit_type IS NOT NULL GROUP BY deposit_type)"))
def q_cancellation_by_deposit(spark, sf_dir):
    """Cancellations per deposit type."""
    return rounded(M.cancellation_by_deposit(bk(spark, sf_dir)))


@register("weekend_split", _scalar_sql([
    ("avg_weekend_nights", r6("avg(stays_in_weekend_nights)")),
    ("avg_week_nights", r6("avg(stays_in_week_nights)")),
    ("weekend_ratio", r6("avg(stays_in_weekend_nights) / (avg(stays_in_weekend_nights) + avg(stays_in_week_nights))"))]))
def q_weekend_split(spark, sf_dir):
    """Weekend vs week nights and the weekend share."""
    return rounded(M.weekend_split(bk(spark, sf_dir)))


@register("weekend_only", _scalar_sql([
    ("weekend_only_stays", "CAST(count(*) FILTER (WHERE stays_in_weekend_nights > 0 AND stays_in_week_nights = 0) AS BIGINT)"),
    ("weekend_only_rate", r6("avg(CASE WHEN stays_in_weekend_nights > 0 AND stays_in_week_nights = 0 THEN 1 ELSE 0 END)"))]))
def q_weekend_only(spark, sf_dir):
    """Weekend-only stays and their share."""
    return rounded(M.weekend_only(bk(spark, sf_dir)))


@register("top_agents", on_bk(
    "SELECT agent, CAST(count(*) AS BIGINT) AS n FROM bk WHERE agent IS NOT NULL GROUP BY agent "
    "ORDER BY n DESC, agent LIMIT 10"))
def q_top_agents(spark, sf_dir):
    """Ten most frequent agents."""
    return M.top_agents(bk(spark, sf_dir))


@register("top_companies", on_bk(
    "SELECT company, CAST(count(*) AS BIGINT) AS n FROM bk WHERE company IS NOT NULL GROUP BY company "
    "ORDER BY n DESC, company LIMIT 10"))
def q_top_companies(spark, sf_dir):
    """Ten most frequent companies (-1 = none, included)."""
    return M.top_companies(bk(spark, sf_dir))


@register("stay_stats", _scalar_sql([
    ("avg_stay", r6("avg(total_nights)")), ("median_stay", r6("quantile_cont(total_nights, 0.5)")),
    ("max_stay", r6("max(total_nights)"))]))
def q_stay_stats(spark, sf_dir):
    """Mean, median, longest stay."""
    return rounded(M.stay_stats(bk(spark, sf_dir)))


@register("stay_by_hotel", on_bk(
    f"SELECT hotel, {r6('avg(total_nights)')} AS avg_stay FROM bk WHERE hotel IS NOT NULL GROUP BY hotel"))
def q_stay_by_hotel(spark, sf_dir):
    """Mean stay per hotel."""
    return rounded(M.stay_by_hotel(bk(spark, sf_dir)))


# --------------------------------------------------------------------------
# Database statistics and EDA
# --------------------------------------------------------------------------

@register("db_stats", _scalar_sql([
    ("total_bookings", "CAST(count(*) AS BIGINT)"),
    ("canceled_bookings", "CAST(count(*) FILTER (WHERE is_canceled = 1) AS BIGINT)"),
    ("cancellation_rate", r6("count(*) FILTER (WHERE is_canceled = 1) / count(*)")),
    ("distinct_countries", "CAST(count(DISTINCT country) AS BIGINT)"),
    ("last_update", "max(last_updated)")]))
def q_db_stats(spark, sf_dir):
    """Database statistics."""
    return rounded(M.db_stats(bk(spark, sf_dir)))


@register("hotels_with_null", f"""SELECT CASE WHEN country IS NOT NULL THEN hotel END AS hotel, CAST(count(*) AS BIGINT) AS n FROM ({bookings_view_sql()}) GROUP BY ALL""")
def q_hotels_with_null(spark, sf_dir):
    """Raw bookings per hotel; those without a country count as without a hotel (NULL kept)."""
    return M.hotels_with_null(bookings(spark, sf_dir).withColumn("hotel", F.when(F.col("country").isNotNull(), F.col("hotel"))))


@register("year_distribution", on_bk(
    "SELECT arrival_date_year, CAST(count(*) AS BIGINT) AS n FROM bk GROUP BY arrival_date_year"))
def q_year_distribution(spark, sf_dir):
    """Bookings per arrival year (NULL year kept)."""
    return M.year_distribution(bk(spark, sf_dir))


@register("revenue_by_year_month", on_bk(
    f"SELECT arrival_date_year, arrival_date_month, {r2('COALESCE(sum(revenue), 0)')} AS revenue, "
    "CAST(list_position(['January','February','March','April','May','June','July','August','September',"
    "'October','November','December'], arrival_date_month) AS INT) AS month_no FROM bk "
    "GROUP BY arrival_date_year, arrival_date_month"))
def q_revenue_by_year_month(spark, sf_dir):
    """Revenue per (year, month)."""
    return rounded(M.revenue_by_year_month(bk(spark, sf_dir)), money=("revenue",))


@register("top_countries", on_bk(
    "SELECT country, CAST(count(*) AS BIGINT) AS n FROM bk WHERE country IS NOT NULL GROUP BY country "
    "ORDER BY n DESC, country LIMIT 10"))
def q_top_countries(spark, sf_dir):
    """Ten busiest countries."""
    return M.top_countries(bk(spark, sf_dir))


def _argmax_sql(where: str, key: str, alias: str) -> str:
    return (f"(SELECT {key} AS {alias}, CAST(count(*) AS BIGINT) AS {alias}_n FROM bk WHERE {key} IS NOT NULL {where} "
            f"GROUP BY {key} ORDER BY count(*) DESC, {key} LIMIT 1)")


_EDA_SQL = on_bk("""SELECT s.*, a.busiest_country, a.busiest_country_n AS busiest_country_bookings,
  b.most_canceled_country, b.most_canceled_country_n, h.most_canceled_hotel, h.most_canceled_hotel_n
FROM (SELECT
    ROUND(COALESCE(sum(CASE WHEN arrival_date_year = 1997 AND arrival_date_month = 'July' THEN revenue END), 0), 2)
      AS revenue_month,
    ROUND(avg(CAST(is_canceled AS DOUBLE)) * 100, 6) AS cancellation_pct,
    ROUND(count(*) FILTER (WHERE hotel = 'Resort Hotel' AND is_canceled = 1) * 100.0
      / count(*) FILTER (WHERE hotel = 'Resort Hotel'), 6) AS resort_cancellation_pct,
    CAST(count(*) FILTER (WHERE total_of_special_requests > 0) AS BIGINT) AS special_request_bookings,
    ROUND(count(*) FILTER (WHERE is_repeated_guest = 1) * 100.0 / count(*), 6) AS repeat_guest_pct,
    ROUND(avg(adr), 6) AS avg_adr
  FROM bk) s, """ + _argmax_sql("", "country", "busiest_country") + " a, "
    + _argmax_sql("AND is_canceled = 1", "country", "most_canceled_country") + " b, "
    + _argmax_sql("AND is_canceled = 1", "hotel", "most_canceled_hotel") + " h")


@register("eda_answers", _EDA_SQL)
def q_eda_answers(spark, sf_dir):
    """The seven headline figures (July of year 1997 for revenue)."""
    return rounded(M.eda_answers(bk(spark, sf_dir), 1997, "July"), money=("revenue_month",))


def _hist_sql(col: str, bins: int = 50) -> str:
    return on_bk(
        f"SELECT b.bin, ROUND(s.lo + (s.hi - s.lo) * b.bin / {bins}, 6) AS bin_start, "
        f"ROUND(s.lo + (s.hi - s.lo) * (b.bin + 1) / {bins}, 6) AS bin_end, CAST(COALESCE(c.n, 0) AS BIGINT) AS n "
        f"FROM (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM bk) s "
        f"CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range({bins})) b "
        f"LEFT JOIN (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) END AS INT) AS bin, "
        f"count(*) AS n FROM (SELECT CAST({col} AS DOUBLE) AS x FROM bk WHERE {col} IS NOT NULL), "
        f"(SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM bk) GROUP BY 1) c USING (bin)")


@register("histogram_lead", _hist_sql("lead_time"))
def q_histogram_lead(spark, sf_dir):
    """50 equal-width bins of lead time."""
    from ..functions.quantiles import equal_width_histogram
    return rounded(equal_width_histogram(bk(spark, sf_dir), "lead_time", 50))


@register("histogram_revenue", _hist_sql("revenue"))
def q_histogram_revenue(spark, sf_dir):
    """50 equal-width bins of revenue."""
    from ..functions.quantiles import equal_width_histogram
    return rounded(equal_width_histogram(bk(spark, sf_dir), "revenue", 50))


@register("quantile_revenue", _scalar_sql([("revenue_q", r2("quantile_cont(revenue, 0.95)"))]))
def q_quantile_revenue(spark, sf_dir):
    """95 % revenue quantile (linear interpolation)."""
    return rounded(M.revenue_quantile(bk(spark, sf_dir), 0.95), money=("revenue_q",))


@register("distinct_counts", _scalar_sql([
    (f"{c}_distinct", f"CAST(count(DISTINCT {c}) AS BIGINT)") for c in
    ["hotel", "arrival_date_month", "meal", "country", "market_segment", "distribution_channel",
     "reserved_room_type", "assigned_room_type", "deposit_type", "customer_type", "reservation_status"]]))
def q_distinct_counts(spark, sf_dir):
    """Distinct values of each text column."""
    return M.distinct_counts(bk(spark, sf_dir))


def _fused_sql() -> str:
    parts = []
    for name, key in M.DISTRIBUTION_KEYS.items():
        parts.append(f"SELECT '{name}' AS metric, CAST({key} AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n "
                     f"FROM bk WHERE {key} IS NOT NULL GROUP BY {key}")
    return on_bk(" UNION ALL ".join(parts))


@register("fused_distributions", _fused_sql())
def q_fused_distributions(spark, sf_dir):
    """M2/M13/M16/M21/M22/M24/M26 in one GROUPING SETS pass."""
    return M.fused_distributions(bk(spark, sf_dir))
