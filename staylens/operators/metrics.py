"""The metric menu (M1-M44) over a cleaned bookings frame.

Every metric takes ``by`` (grouping columns, empty for the whole frame) so the
same code answers one question or a whole table of questions grouped by
``qid``/scope. Scalar metrics are declared as aggregate Column lists so any set
of them fuses into ONE ``agg`` (one scan, one partial+final hash aggregate).
Distributions drop NULL keys (value-count semantics) unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import all_of, differs, ratio
from ..functions.quantiles import approx_quantile, linear_quantiles
from ..sources.schema import MONTHS, STRING_COLUMNS, WAITLIST_LABELS
from .topk import arg_max_count, frequency_top_k, top_k

def _n() -> Column:
    """Row count (``count(*)``)."""
    return F.count(F.lit(1))


def _sum0(c: str | Column) -> Column:
    """Sum that is 0 (not NULL) over an empty or all-NULL input."""
    return F.coalesce(F.sum(c), F.lit(0))


# --------------------------------------------------------------------------
# Scalar metric blocks: name -> [(output column, aggregate expression)]
# --------------------------------------------------------------------------

#: Scalars that are medians: found by counting values, not by an aggregate that holds them.
MEDIANS = {"median_price": "adr", "median_lead_time": "lead_time", "median_stay": "total_nights"}


def scalar_blocks() -> dict[str, list[tuple[str, Column]]]:
    median = approx_quantile
    we, wk = F.avg("stays_in_weekend_nights"), F.avg("stays_in_week_nights")
    weekend_only = (F.col("stays_in_weekend_nights") > 0) & (F.col("stays_in_week_nights") == 0)
    return {
        "records": [("total_records", _n())],
        "revenue_totals": [
            ("total_revenue", _sum0("revenue").cast("double")),
            ("avg_revenue", F.avg("revenue")),
        ],
        "cancellation": [
            ("total_bookings", _n()),
            ("canceled_bookings", _sum0("is_canceled").cast("long")),
            ("cancellation_rate", ratio(_sum0("is_canceled"), _n())),
        ],
        "price_stats": [
            ("avg_price", F.avg("adr")),
            ("median_price", median("adr", 0.5)),
            ("min_price", F.min("adr").cast("double")),
            ("max_price", F.max("adr").cast("double")),
        ],
        "guests": [("avg_guests_per_booking", F.avg("total_guests"))],
        "lead_stats": [
            ("avg_lead_time", F.avg("lead_time")),
            ("median_lead_time", median("lead_time", 0.5)),
        ],
        "repeat_guests": [
            ("repeat_guests", _sum0("is_repeated_guest").cast("long")),
            ("repeat_rate", ratio(_sum0("is_repeated_guest"), _n())),
            ("avg_previous_stays", F.avg("previous_bookings_not_canceled")),
            ("avg_previous_cancellations", F.avg("previous_cancellations")),
        ],
        "room_change": [
            ("room_change_rate", F.avg(differs("reserved_room_type", "assigned_room_type").cast("int"))),
        ],
        "booking_changes": [
            ("bookings_with_changes", F.count_if(F.col("booking_changes") > 0)),
            ("change_rate", ratio(F.count_if(F.col("booking_changes") > 0), _n())),
            ("avg_changes", F.avg("booking_changes")),
        ],
        "special_requests": [
            ("bookings_with_requests", F.count_if(F.col("total_of_special_requests") > 0)),
            ("request_rate", ratio(F.count_if(F.col("total_of_special_requests") > 0), _n())),
            ("avg_requests", F.avg("total_of_special_requests")),
        ],
        "waitlist": [
            ("bookings_waitlisted", F.count_if(F.col("days_in_waiting_list") > 0)),
            ("waitlist_rate", ratio(F.count_if(F.col("days_in_waiting_list") > 0), _n())),
            ("avg_waitlist_days", F.avg("days_in_waiting_list")),
        ],
        "weekend_split": [
            ("avg_weekend_nights", we),
            ("avg_week_nights", wk),
            ("weekend_ratio", ratio(we, we + wk)),
        ],
        "weekend_only": [
            ("weekend_only_stays", F.count_if(weekend_only)),
            ("weekend_only_rate", F.avg(F.coalesce(weekend_only, F.lit(False)).cast("int"))),
        ],
        "stay_stats": [
            ("avg_stay", F.avg("total_nights")),
            ("median_stay", median("total_nights", 0.5)),
            ("max_stay", F.max("total_nights").cast("double")),
        ],
    }


def scalars(df: DataFrame, blocks: list[str], by: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Any set of scalar blocks fused into one aggregate; exact medians are counted aside unless ``approx``."""
    table, by = scalar_blocks(), list(by or [])
    names = [name for b in blocks for name, _ in table[b]]
    exprs = [e.alias(name) for b in blocks for name, e in table[b] if approx or name not in MEDIANS]
    out = df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)
    medians = [] if approx else [n for n in names if n in MEDIANS]
    if medians:  # all of them in one chain, as one long column
        values = F.array(*[F.struct(F.lit(n).alias("what"), F.col(MEDIANS[n]).cast("double").alias("value")) for n in medians])
        long = df.select(*by, F.explode(F.filter(values, lambda v: v["value"].isNotNull())).alias("v")).select(*by, "v.what", "v.value")
        mid = linear_quantiles(long, "value", {"q": 0.5}, [*by, "what"])
        wide = [F.max(F.when(F.col("what") == n, F.col("q"))).alias(n) for n in medians]
        if by:
            keys = mid.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(*wide)
            out = out.join(keys, all_of([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]), "left").drop(*[f"_{k}" for k in by])
        else:
            one = mid.agg(F.struct(*wide)).scalar()
            out = out.withColumns({n: one.getField(n) for n in medians})
    return out.select(*by, *names)


def records(df, by=None):  # M1
    return scalars(df, ["records"], by)


def revenue_totals(df, by=None):  # M3
    return scalars(df, ["revenue_totals"], by)


def cancellation(df, by=None):  # M5
    return scalars(df, ["cancellation"], by)


def price_stats(df, by=None, approx=False):  # M7
    return scalars(df, ["price_stats"], by, approx)


def guests(df, by=None):  # M11
    return scalars(df, ["guests"], by)


def lead_stats(df, by=None, approx=False):  # M13
    return scalars(df, ["lead_stats"], by, approx)


def repeat_guests(df, by=None):  # M14, M15
    return scalars(df, ["repeat_guests"], by)


def room_change(df, by=None):  # M17
    return scalars(df, ["room_change"], by)


def booking_changes(df, by=None):  # M18
    return scalars(df, ["booking_changes"], by)


def special_requests(df, by=None):  # M19
    return scalars(df, ["special_requests"], by)


def waitlist(df, by=None):  # M20
    return scalars(df, ["waitlist"], by)


def weekend_split(df, by=None):  # M28
    return scalars(df, ["weekend_split"], by)


def weekend_only(df, by=None):  # M29
    return scalars(df, ["weekend_only"], by)


def stay_stats(df, by=None, approx=False):  # M32
    return scalars(df, ["stay_stats"], by, approx)


# --------------------------------------------------------------------------
# Keyed metrics
# --------------------------------------------------------------------------

def value_counts(df: DataFrame, key: str, by: list[str] | None = None, name: str = "n") -> DataFrame:
    """Count per non-NULL key."""
    by = list(by or [])
    return df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(_n().alias(name))


def keyed(df: DataFrame, key: str, expr: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """One aggregate per non-NULL key."""
    by = list(by or [])
    return df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(expr.alias(name))


def hotel_distribution(df, by=None):  # M2
    return value_counts(df, "hotel", by)


def revenue_by_hotel(df, by=None):  # M4
    return keyed(df, "hotel", _sum0("revenue").cast("double"), "total_revenue", by)


def adr_by_hotel(df, by=None):  # M8
    return keyed(df, "hotel", F.avg("adr"), "avg_adr", by)


def guests_by_segment(df, by=None):  # M12 (descending order is a presentation concern)
    return keyed(df, "market_segment", _sum0("total_guests").cast("double"), "total_guests", by)


def lead_distribution(df, by=None):  # M13
    return value_counts(df, "lead_time_category", by)


def lead_by_hotel(df, by=None):  # M13
    return keyed(df, "hotel", F.avg("lead_time"), "avg_lead_time", by)


def room_distribution(df, by=None):  # M16
    return value_counts(df, "reserved_room_type", by)


def meal_distribution(df, by=None):  # M22
    return value_counts(df, "meal", by)


def channel_distribution(df, by=None):  # M24
    return value_counts(df, "distribution_channel", by)


def segment_distribution(df, by=None):  # M24
    return value_counts(df, "market_segment", by)


def revenue_by_channel(df, by=None):  # M25
    return keyed(df, "distribution_channel", _sum0("revenue").cast("double"), "revenue", by)


def revenue_by_segment(df, by=None):  # M25
    return keyed(df, "market_segment", _sum0("revenue").cast("double"), "revenue", by)


def deposit_distribution(df, by=None):  # M26
    return value_counts(df, "deposit_type", by)


def stay_by_hotel(df, by=None):  # M33
    return keyed(df, "hotel", F.avg("total_nights"), "avg_stay", by)


def cancellation_by(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """sum / count / rate of ``is_canceled`` per non-NULL key (M6, M27); bookings without the field aren't counted."""
    by = list(by or [])
    s = _sum0("is_canceled").cast("long")
    return (
        df.where(F.col(key).isNotNull()).groupBy(*by, key)
        .agg(s.alias("canceled"), F.count("is_canceled").alias("bookings"))
        .withColumn("rate", ratio("canceled", "bookings"))
    )


def cancellation_by_country(df, by=None, k: int = 10):  # M6
    stats = cancellation_by(df, "country", by)
    return top_k(stats, k, [F.col("canceled").desc(), F.col("country").asc()], by)


def cancellation_by_deposit(df, by=None):  # M27
    return cancellation_by(df, "deposit_type", by)


def top_agents(df, by=None, k: int = 10):  # M30
    return frequency_top_k(df, "agent", k, by)


def top_companies(df, by=None, k: int = 10):  # M31
    return frequency_top_k(df, "company", k, by)


def top_countries(df, by=None, k: int = 10):  # M36
    return frequency_top_k(df, "country", k, by)


def _with_dimension(df: DataFrame, key: str, labels: list[str], measure: str, by: list[str]) -> DataFrame:
    """Left-join a fixed label dimension so every label appears once per group.

    The dimension is expanded per group from a literal array (``explode``), so
    no cross join is needed; absent labels get a NULL measure.
    """
    order = F.array(*[F.lit(v) for v in labels])
    if by:
        groups = df.select(*by).distinct()
    else:
        groups = df.sparkSession.range(1).select()
    dims = groups.select(*by, F.posexplode(order).alias("_pos", key))
    return (
        dims.join(df, [*by, key], "left")
        .select(*by, key, (F.col("_pos") + 1).alias(f"{key}_order"), measure)
    )


def bookings_by_month(df, by=None):  # M9: calendar order, absent months NULL
    by = list(by or [])
    counts = df.where(F.col("arrival_date_month").isNotNull()).groupBy(*by, "arrival_date_month").agg(
        F.count("is_canceled").alias("bookings"))
    return _with_dimension(counts, "arrival_date_month", MONTHS, "bookings", by)


def revenue_by_month(df, by=None):  # M10
    by = list(by or [])
    sums = df.where(F.col("arrival_date_month").isNotNull()).groupBy(*by, "arrival_date_month").agg(
        _sum0("revenue").cast("double").alias("revenue"))
    return _with_dimension(sums, "arrival_date_month", MONTHS, "revenue", by)


def waitlist_distribution(df, by=None, include_empty: bool = True):  # M21
    """Counts per waiting-list bin; with ``include_empty`` all four bins appear (0 when empty)."""
    by = list(by or [])
    counts = value_counts(df, "waitlist_category", by)
    if not include_empty:
        return counts
    out = _with_dimension(counts, "waitlist_category", WAITLIST_LABELS, "n", by)
    return out.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def meal_by_country(df: DataFrame, by: list[str] | None = None, k: int = 5) -> DataFrame:
    """Meal counts for the ``k`` busiest countries, one row per (country, meal), empty cell 0.

    Meals are the distinct meals of the (group's) frame. Instead of a pivot
    (data-dependent columns) or a cross join, each busiest country carries a
    meal -> count map and the group's sorted meal list is exploded against it.
    """
    by = list(by or [])
    cells = df.where(F.col("country").isNotNull() & F.col("meal").isNotNull()).groupBy(*by, "country", "meal").agg(
        _n().alias("n"))
    per_country = cells.groupBy(*by, "country").agg(
        F.sum("n").alias("_total"), F.map_from_entries(F.collect_list(F.struct("meal", "n"))).alias("_m"))
    busiest = top_k(per_country, k, [F.col("_total").desc(), F.col("country").asc()], by)
    meals = cells.groupBy(*by).agg(F.array_sort(F.collect_set("meal")).alias("_meals"))
    if by:
        joined = busiest.join(meals, by)
    else:
        joined = busiest.withColumn("_meals", meals.select("_meals").scalar())
    return joined.select(
        *by, "country", F.explode("_meals").alias("meal"), "_m"
    ).select(*by, "country", "meal", F.coalesce(F.element_at("_m", F.col("meal")), F.lit(0)).cast("long").alias("n"))


# --------------------------------------------------------------------------
# Database statistics and EDA figures
# --------------------------------------------------------------------------

def db_stats(df: DataFrame, update_log: DataFrame | None = None) -> DataFrame:
    """M34 scalars: totals, cancellation rate, distinct countries, latest update (one agg);
    with ``update_log`` also its size (``total_updates``, a scalar subquery)."""
    canceled = F.count_if(F.col("is_canceled") == 1)
    if update_log is not None:
        n_log = update_log.select(F.count(F.lit(1))).scalar()
        return db_stats(df).withColumn("total_updates", n_log)
    return df.agg(
        _n().alias("total_bookings"),
        canceled.alias("canceled_bookings"),
        ratio(canceled, _n()).alias("cancellation_rate"),
        F.count_distinct("country").alias("distinct_countries"),
        F.max("last_updated").alias("last_update"),
    )


def year_distribution(df: DataFrame) -> DataFrame:
    """Bookings per arrival year, NULL year kept as its own group (SQL GROUP BY)."""
    return df.groupBy("arrival_date_year").agg(_n().alias("n"))


def hotels_with_null(df: DataFrame) -> DataFrame:
    """Bookings per hotel, NULL hotel kept as its own group (SQL GROUP BY)."""
    return df.groupBy("hotel").agg(_n().alias("n"))


def revenue_by_year_month(df: DataFrame) -> DataFrame:
    """Revenue per (year, month), with the month number for calendar order."""
    from ..functions.exprs import month_number

    return df.groupBy("arrival_date_year", "arrival_date_month").agg(_sum0("revenue").cast("double").alias("revenue")) \
        .withColumn("month_no", month_number("arrival_date_month"))


def eda_answers(df: DataFrame, year: int, month: str = "July") -> DataFrame:
    """M37, M40-M43 and M36's arg-max: the seven reference figures, one row.

    One scalar aggregate for the sums/rates plus three arg-max lookups
    (country by bookings, country and hotel by cancellations), each a grouped
    count reduced to one row, combined as scalar subqueries.
    """
    resort = F.col("hotel") == "Resort Hotel"
    scal = df.agg(
        _sum0(F.when((F.col("arrival_date_year") == year) & (F.col("arrival_date_month") == month),
                     F.col("revenue"))).cast("double").alias("revenue_month"),
        (F.avg(F.col("is_canceled").cast("double")) * 100).alias("cancellation_pct"),
        ratio(F.count_if(resort & (F.col("is_canceled") == 1)) * 100, F.count_if(resort)).alias("resort_cancellation_pct"),
        F.count_if(F.col("total_of_special_requests") > 0).alias("special_request_bookings"),
        ratio(F.count_if(F.col("is_repeated_guest") == 1) * 100, _n()).alias("repeat_guest_pct"),
        F.avg("adr").alias("avg_adr"),
    )
    busiest = arg_max_count(df, "country").select(F.struct(F.col("country"), F.col("n")).alias("s")).scalar()
    canceled = df.where(F.col("is_canceled") == 1)
    most_c = arg_max_count(canceled, "country").select(F.struct(F.col("country"), F.col("n")).alias("s")).scalar()
    most_h = arg_max_count(canceled, "hotel").select(F.struct(F.col("hotel"), F.col("n")).alias("s")).scalar()
    return scal.select(
        "*",
        busiest.getField("country").alias("busiest_country"),
        busiest.getField("n").alias("busiest_country_bookings"),
        most_c.getField("country").alias("most_canceled_country"),
        most_c.getField("n").alias("most_canceled_country_n"),
        most_h.getField("hotel").alias("most_canceled_hotel"),
        most_h.getField("n").alias("most_canceled_hotel_n"),
    )


def revenue_quantile(df: DataFrame, q: float = 0.95, approx: bool = False) -> DataFrame:
    """Linear-interpolated quantile of revenue (the plot's upper cut)."""
    if approx:
        return df.agg(approx_quantile("revenue", q).alias("revenue_q"))
    return linear_quantiles(df, "revenue", {"revenue_q": q})


def distinct_counts(df: DataFrame, columns: list[str] = STRING_COLUMNS, approx: bool = False) -> DataFrame:
    """Distinct values per text column in one aggregate (approx: HyperLogLog++)."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[f(c).alias(f"{c}_distinct") for c in columns])


DISTRIBUTION_KEYS = {
    "hotel_distribution": "hotel",
    "room_type_distribution": "reserved_room_type",
    "waitlist_distribution": "waitlist_category",
    "meal_distribution": "meal",
    "channel_distribution": "distribution_channel",
    "segment_distribution": "market_segment",
    "deposit_distribution": "deposit_type",
    "lead_time_distribution": "lead_time_category",
}


def fused_distributions(df: DataFrame, by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """M2, M13, M16, M21, M22, M24, M26 in ONE pass: GROUPING SETS over the keys.

    Output is long: (by..., metric, key, n) with NULL keys dropped; one scan
    and one shuffle serve all distributions.
    """
    by = list(by or [])
    names = names or list(DISTRIBUTION_KEYS)
    keys = [DISTRIBUTION_KEYS[n] for n in names]
    sets = ", ".join("(" + ", ".join([*by, k]) + ")" for k in keys)
    flags = ", ".join(f"grouping({k}) AS _g_{i}" for i, k in enumerate(keys))
    view = df.select(*by, *keys)
    agg = view.sparkSession.sql(
        f"SELECT {', '.join([*by, *keys])}, {flags}, count(1) AS n FROM {{v}} GROUP BY GROUPING SETS ({sets})",
        v=view,
    )
    metric = None
    key = None
    for i, (n, k) in enumerate(zip(names, keys)):
        cond = F.col(f"_g_{i}") == 0
        metric = F.when(cond, F.lit(n)) if metric is None else metric.when(cond, F.lit(n))
        key = F.when(cond, F.col(k).cast("string")) if key is None else key.when(cond, F.col(k).cast("string"))
    return agg.select(*by, metric.alias("metric"), key.alias("key"), F.col("n")).where(F.col("key").isNotNull())

