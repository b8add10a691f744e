"""Question answering as a batch job.

A table of questions ``(qid, text)`` is answered in one Spark job:

1. ``question_spec``   text -> filter spec columns (regex / substring, row-local).
2. ``booking_cells``   bookings pre-aggregated to the grain the specs can test
                       (year, month, hotel, country, lead class, status, flags);
                       a hot key collapses into one cell, so skew cannot hurt.
3. ``match_specs``     distinct specs x cells through an equi-join on
                       mask-expanded keys: each cell is emitted once per
                       "which of year/month/hotel is constrained" mask in use
                       (at most 8), and the remaining predicates are a residual
                       filter. No cross join, no size switch: Spark plans the join.
4. ``spec_scopes``     F17: a year/month/country/hotel that is unique among a
                       spec's matches becomes a scope on the whole table.
5. ``scope_metrics``   the triggered metrics for every scope: bookings are
                       aggregated once to partials per class of bookings that
                       fall in the same scopes (sums and counts, value counts,
                       GROUPING SETS), and only these partials meet the scopes;
                       the classes come from the values of year, month, country
                       and hotel that occur, again by a mask-expanded
                       equi-join (``scoped``); F18 (direct scope)
                       groups ``filtered_bookings`` by spec instead.
6. ``analyse``         per question: the triggered metrics, context text (X5),
                       prompt (X6), template answer (X7), empty answer (X8).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import all_of, differs, ratio
from ..functions.quantiles import linear_quantiles
from ..session import shared_path
from ..sources.schema import MONTHS

# --------------------------------------------------------------------------
# Fixed values (must equal the original service's)
# --------------------------------------------------------------------------

YEAR_PATTERN = r"(\d{4})"
MONTH_PATTERN = "(?i)(January|February|March|April|May|June|July|August|September|October|November|December)"

# lead-time phrase -> inclusive day range; all matching phrases are AND-ed
LEAD_PATTERNS = [
    ("(?i)(last minute|last-minute)", 0, 7),
    ("(?i)(short notice|short-notice)", 0, 30),
    ("(?i)(advance|early)", 90, 1000),
]

EMPTY_ANSWER = "I couldn't find any data matching your query criteria."

PROMPT_TEMPLATE = (
    "\n            <s>[INST] You are a hotel data analyst assistant. Use only the information provided in the "
    "context to answer the question. Be specific, concise, and provide numerical results when available."
    "\n\n            Context:\n            {context}\n            \n            Question: {question}"
    "\n            \n            Answer: [/INST]\n            "
)

# metric block -> trigger substrings of the lower-cased question (empty = always runs)
BLOCK_TRIGGERS: dict[str, list[str]] = {
    "always": [],
    "revenue": ["revenue", "income"],
    "cancel": ["cancel"],
    "price": ["price", "adr", "rate"],
    "season": ["season", "month"],
    "guest": ["guest", "customer"],
    "lead": ["lead", "book in advance"],
    "repeat": ["repeat", "return", "loyal"],
    "room": ["room", "type"],
    "change": ["change", "modify"],
    "request": ["special", "request"],
    "wait": ["wait", "waitlist"],
    "meal": ["meal", "food", "board"],
    "channel": ["channel", "book", "segment"],
    "deposit": ["deposit", "payment"],
    "weekend": ["weekend", "weekday", "week"],
    "agent": ["agent", "company"],
    "stay": ["stay", "duration", "length"],
}
# cancellation by country needs "cancel" and one of these
LOCATION_TRIGGERS = ["country", "location"]

# result order of the service (metric name, block, kind); kind: int | float | dict | nested
RESULT_ORDER: list[tuple[str, str, str]] = [
    ("total_records", "always", "int"), ("filtered_records", "always", "int"),
    ("hotel_distribution", "always", "dict"),
    ("total_revenue", "revenue", "float"), ("avg_revenue", "revenue", "float"),
    ("revenue_by_hotel", "revenue", "dict"),
    ("total_bookings", "cancel", "int"), ("canceled_bookings", "cancel", "int"),
    ("cancellation_rate", "cancel", "float"), ("cancellation_by_country", "cancel_location", "nested"),
    ("avg_price", "price", "float"), ("median_price", "price", "float"), ("min_price", "price", "float"),
    ("max_price", "price", "float"), ("adr_by_hotel", "price", "dict"),
    ("bookings_by_month", "season", "dict"), ("revenue_by_month", "season", "dict"),
    ("avg_guests_per_booking", "guest", "float"), ("guests_by_segment", "guest", "dict"),
    ("avg_lead_time", "lead", "float"), ("median_lead_time", "lead", "float"),
    ("lead_time_distribution", "lead", "dict"), ("lead_time_by_hotel", "lead", "dict"),
    ("repeat_guests", "repeat", "int"), ("repeat_rate", "repeat", "float"),
    ("avg_previous_stays", "repeat", "float"), ("avg_previous_cancellations", "repeat", "float"),
    ("room_type_distribution", "room", "dict"), ("room_change_rate", "room", "float"),
    ("bookings_with_changes", "change", "int"), ("change_rate", "change", "float"), ("avg_changes", "change", "float"),
    ("bookings_with_requests", "request", "int"), ("request_rate", "request", "float"),
    ("avg_requests", "request", "float"),
    ("bookings_waitlisted", "wait", "int"), ("waitlist_rate", "wait", "float"),
    ("avg_waitlist_days", "wait", "float"), ("waitlist_distribution", "wait", "dict"),
    ("meal_distribution", "meal", "dict"), ("meal_preferences_by_country", "meal", "nested"),
    ("channel_distribution", "channel", "dict"), ("segment_distribution", "channel", "dict"),
    ("revenue_by_channel", "always", "dict"), ("revenue_by_segment", "always", "dict"),
    ("deposit_distribution", "deposit", "dict"), ("cancellation_by_deposit", "deposit", "nested"),
    ("avg_weekend_nights", "weekend", "float"), ("avg_week_nights", "weekend", "float"),
    ("weekend_ratio", "weekend", "float"), ("weekend_only_stays", "weekend", "int"),
    ("weekend_only_rate", "weekend", "float"),
    ("top_agents", "agent", "dict"), ("top_companies", "always", "dict"),
    ("avg_stay", "stay", "float"), ("median_stay", "stay", "float"), ("max_stay", "stay", "int"),
    ("stay_by_hotel", "stay", "dict"),
]
SERVICE_SKIPS_BLOCKS = ["lead"]  # the lead-time block exists only in the notebook engine

# --------------------------------------------------------------------------
# 1. Question -> spec
# --------------------------------------------------------------------------

SPEC_COLUMNS = ["year", "month", "hotel", "want_canceled", "want_checkout", "want_noshow",
                "want_repeat", "want_requests", "want_parking", "lead_lo", "lead_hi"]


def _has(low: Column, *subs: str) -> Column:
    return _any([low.contains(s) for s in subs])


def _any(preds: list[Column]) -> Column:
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out


def question_spec(questions: DataFrame, text: str = "text", fix_negation: bool = False) -> DataFrame:
    """The structured filter a question asks for, as nullable columns.

    NULL means "no constraint". ``fix_negation`` makes "not cancelled" select
    non-cancelled bookings (in the service that branch is unreachable).
    """
    t = F.col(text)
    low = F.lower(t)
    year = F.nullif(F.regexp_extract(t, YEAR_PATTERN, 1), F.lit("")).try_cast("int")
    month_raw = F.nullif(F.regexp_extract(t, MONTH_PATTERN, 1), F.lit(""))
    month = F.initcap(month_raw)
    canceled = _has(low, "canceled", "cancelled")
    negated = _has(low, "not canceled", "not cancelled")
    if fix_negation:
        want_canceled = F.when(negated, F.lit(0)).when(canceled, F.lit(1))
    else:
        want_canceled = F.when(canceled, F.lit(1)).when(negated, F.lit(0))
    lead_hits = [(F.coalesce(t.rlike(p), F.lit(False)), lo, hi) for p, lo, hi in LEAD_PATTERNS]
    lead_lo = F.greatest(*[F.when(h, F.lit(lo)) for h, lo, _ in lead_hits])
    lead_hi = F.least(*[F.when(h, F.lit(hi)) for h, _, hi in lead_hits])
    return questions.withColumns({
        "year": F.when(year != 0, year),  # year 0 is falsy in the service: no filter
        "month": month,
        "hotel": F.when(low.contains("resort"), F.lit("Resort Hotel")).when(low.contains("city"), F.lit("City Hotel")),
        "want_canceled": want_canceled,
        "want_checkout": _has(low, "checked out", "check-out"),
        "want_noshow": _has(low, "no-show", "no show"),
        "want_repeat": F.when(_has(low, "repeat", "returning"), F.lit(1)).when(
            _has(low, "first time", "new customer"), F.lit(0)),
        "want_requests": _has(low, "special request"),
        "want_parking": _has(low, "parking"),
        "lead_lo": lead_lo,
        "lead_hi": lead_hi,
    })


def _identity(*columns: str | Column) -> Column:
    """The columns as one JSON text with NULLs kept in place: equal texts mean equal columns, nothing is hashed."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def with_spec_id(spec: DataFrame) -> DataFrame:
    """Identity of a spec (equal specs share it, so they are evaluated once; different ones never do)."""
    return spec.withColumn("spec_id", _identity(*SPEC_COLUMNS))


# --------------------------------------------------------------------------
# 2. Booking cells
# --------------------------------------------------------------------------

def _lead_class(c: Column) -> Column:
    """Index of the interval between the phrase bounds holding ``c`` (class members agree on every phrase)."""
    cuts = sorted({b for _, lo, hi in LEAD_PATTERNS for b in (lo - 0.5, hi + 0.5)})
    expr = F.when(c.isNull(), F.lit(None))
    for i, cut in enumerate(cuts):
        expr = expr.when(c < cut, F.lit(i))
    return expr.otherwise(F.lit(len(cuts)))


def booking_cells(bk: DataFrame) -> DataFrame:
    """Bookings counted per combination of every column a spec or scope can test."""
    return bk.groupBy(
        "arrival_date_year", "arrival_date_month", "hotel", "country",
        _lead_class(F.col("lead_time")).alias("lead_class"),
        "is_canceled", "reservation_status", "is_repeated_guest",
        (F.col("total_of_special_requests") > 0).alias("has_requests"),
        (F.col("required_car_parking_spaces") > 0).alias("has_parking"),
    ).agg(F.count(F.lit(1)).alias("n"), F.min("lead_time").alias("lead_rep"))


# --------------------------------------------------------------------------
# 3. Spec x cells (mask-expanded equi-join)
# --------------------------------------------------------------------------

_STAR = "\u0000*"  # key of an unconstrained dimension; never equal to data


def _mask_keys(values: list[Column], mask: Column) -> list[Column]:
    return [F.when((mask.bitwiseAND(F.lit(1 << i))) != 0, v.cast("string")).otherwise(F.lit(_STAR))
            for i, v in enumerate(values)]


def _spec_mask_keys(values: list[Column]) -> tuple[Column, list[Column]]:
    mask = sum((F.when(v.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(values)), F.lit(0))
    keys = [F.coalesce(v.cast("string"), F.lit(_STAR)) for v in values]
    return mask, keys


def _spec_predicates(is_canceled, status, repeat, has_req, has_park, lead) -> Column:
    """Residual (non-key) spec predicates on a booking or cell; NULL spec fields mean no constraint."""
    return all_of([
        F.col("want_canceled").isNull() | (is_canceled == F.col("want_canceled")),
        ~F.col("want_checkout") | (status == F.lit("Check-Out")),
        ~F.col("want_noshow") | (status == F.lit("No-Show")),
        F.col("want_repeat").isNull() | (repeat == F.col("want_repeat")),
        ~F.col("want_requests") | F.coalesce(has_req, F.lit(False)),
        ~F.col("want_parking") | F.coalesce(has_park, F.lit(False)),
        F.col("lead_lo").isNull() | F.coalesce((lead >= F.col("lead_lo")) & (lead <= F.col("lead_hi")), F.lit(False)),
    ])


def distinct_specs(spec: DataFrame) -> DataFrame:
    """One row per distinct spec, with its join mask and keys (year, lower month, hotel)."""
    mask, keys = _spec_mask_keys([F.col("year"), F.lower(F.col("month")), F.col("hotel")])
    rest = [c for c in SPEC_COLUMNS if c not in ("year", "month", "hotel")]  # those live in the keys
    return (with_spec_id(spec).select("spec_id", *SPEC_COLUMNS).dropDuplicates(["spec_id"])
            .select("spec_id", *rest, mask.alias("_mask"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)]))


def match_specs(specs: DataFrame, cells: DataFrame) -> DataFrame:
    """(spec_id, cell columns) for every cell a spec selects (F16 without candidates)."""
    expanded = _per_mask(cells, specs)
    ek = _mask_keys([F.col("arrival_date_year"), F.lower(F.col("arrival_date_month")), F.col("hotel")], F.col("_mask"))
    expanded = expanded.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(ek)])
    joined = expanded.join(specs, ["_mask", "_k0", "_k1", "_k2"])
    pred = _spec_predicates(F.col("is_canceled"), F.col("reservation_status"),
                            F.col("is_repeated_guest"), F.col("has_requests"), F.col("has_parking"), F.col("lead_rep"))
    return joined.where(pred).drop("_mask", "_k0", "_k1", "_k2")


SCOPE_COLUMNS = {"year": "arrival_date_year", "month": "arrival_date_month", "country": "country", "hotel": "hotel"}


def spec_scopes(matches: DataFrame) -> DataFrame:
    """Per spec: filtered_records and, per scope column, whether it is unique among the matches.

    A column is a scope when the matched rows hold exactly one distinct value,
    NULL counting as a value (then the scope selects nothing, as NULL never equals).
    """
    aggs = [F.sum("n").cast("long").alias("filtered_records")]
    for name, col in SCOPE_COLUMNS.items():
        c = F.col(col)
        single = ((F.min(c) == F.max(c)) & ~F.max(c.isNull())) | F.min(c.isNull())
        aggs += [F.coalesce(single, F.lit(False)).alias(f"scope_{name}_set"), F.min(c).cast("string").alias(f"scope_{name}")]
    return matches.groupBy("spec_id").agg(*aggs)


def candidate_spec_id() -> Column:
    """The spec identity of a question that starts from its own candidates."""
    return F.concat(F.lit("candidates of "), F.col("qid").cast("string"))


def match_candidates(bk: DataFrame, spec: DataFrame, candidates: DataFrame) -> DataFrame:
    """F15 + F16: per question, its candidate rows (e.g. the top-500 semantic hits) that meet its spec.

    ``candidates`` is (qid, id): at most k rows per question, so the table is
    bounded by questions x k and is joined to the bookings by id. Returns the same
    per-spec shape as ``match_specs`` with the qid's spec_id replaced by a
    per-question id, so scopes stay per question.
    """
    tagged = bk.join(candidates.select("qid", "id"), "id")
    q = spec.select("qid", *SPEC_COLUMNS).withColumnRenamed("hotel", "hotel_spec")
    pred = all_of([
        F.col("year").isNull() | (F.col("arrival_date_year") == F.col("year")),
        F.col("month").isNull() | (F.lower(F.col("arrival_date_month")) == F.lower(F.col("month"))),
        F.col("hotel_spec").isNull() | (F.col("hotel") == F.col("hotel_spec")),
        _spec_predicates(F.col("is_canceled"), F.col("reservation_status"),
                         F.col("is_repeated_guest"), F.col("total_of_special_requests") > 0,
                         F.col("required_car_parking_spaces") > 0, F.col("lead_time")),
    ])
    rows = tagged.join(q, "qid").where(pred)
    return rows.select(candidate_spec_id().alias("spec_id"), "qid",
                       *SCOPE_COLUMNS.values(), F.lit(1).cast("long").alias("n"))


# --------------------------------------------------------------------------
# 5. Analysis frames
# --------------------------------------------------------------------------

def scope_table(scopes: DataFrame) -> DataFrame:
    """Distinct scopes (a scope may serve many specs) with mask, keys and scope_id."""
    names = list(SCOPE_COLUMNS)
    mask = sum((F.when(F.col(f"scope_{n}_set"), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(names)),
               F.lit(0))
    # a set scope whose value is NULL keeps a NULL key: it then matches no booking
    keys = [F.when(F.col(f"scope_{n}_set"), F.col(f"scope_{n}")).otherwise(F.lit(_STAR)) for n in names]
    out = scopes.select("spec_id", mask.alias("_mask"), *[k.alias(f"_s{i}") for i, k in enumerate(keys)])
    return out.withColumn("scope_id", _identity("_mask", *[f"_s{i}" for i in range(len(names))]))


def _per_mask(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """Each row once per join mask in use by the spec/scope table (typically 1-3, at most 16 integers in a scalar subquery)."""
    masks = keyed.agg(F.collect_set("_mask")).scalar()
    return rows.withColumn("_masks", masks).select(*rows.columns, F.explode("_masks").alias("_mask"))


def scoped(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows (partial aggregates per scope column, or bookings) tagged with every scope they fall in (``gid`` = scope_id)."""
    distinct = scopes.select("_mask", "_s0", "_s1", "_s2", "_s3", "scope_id").dropDuplicates(["scope_id"])
    expanded = _per_mask(rows, distinct)
    keys = _mask_keys([F.col(c) for c in SCOPE_COLUMNS.values()], F.col("_mask"))
    expanded = expanded.select("*", *[k.alias(f"_s{i}") for i, k in enumerate(keys)])
    joined = expanded.join(distinct, ["_mask", "_s0", "_s1", "_s2", "_s3"])
    return joined.drop("_mask", "_s0", "_s1", "_s2", "_s3").withColumnRenamed("scope_id", "gid")


def scope_classes(bk: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bookings that fall in the same scopes are one class: (scope columns, _class) for the values that occur, and (_class, gid).

    There are no more classes than combinations of the scope columns' values, and few when few scopes are asked for."""
    met = scoped(bk.select(*SCOPE_COLUMNS.values()).distinct(), scopes)
    sets = _staged(met.groupBy(*SCOPE_COLUMNS.values()).agg(F.array_sort(F.collect_set("gid")).alias("_gids")), "scope-sets")
    classes = _staged(sets.select("_gids").distinct().withColumn("_class", F.monotonically_increasing_id()), "scope-classes")
    return _staged(sets.join(classes, "_gids").drop("_gids"), "scope-members"), classes.select("_class", F.explode("_gids").alias("gid"))


def _with_class(bk: DataFrame, members: DataFrame) -> DataFrame:
    """The bookings of some class, each with its ``_class``."""
    named = members.select("_class", *[F.col(c).alias(f"_m_{c}") for c in SCOPE_COLUMNS.values()])
    on = all_of([F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in SCOPE_COLUMNS.values()])
    return bk.join(named, on).drop(*[f"_m_{c}" for c in SCOPE_COLUMNS.values()])


def filtered_bookings(bk: DataFrame, specs: DataFrame) -> DataFrame:
    """bookings tagged with every spec that selects them (``gid`` = spec_id)."""
    expanded = _per_mask(bk, specs)
    ek = _mask_keys([F.col("arrival_date_year"), F.lower(F.col("arrival_date_month")), F.col("hotel")], F.col("_mask"))
    expanded = expanded.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(ek)])
    spec_cols = specs.select("spec_id", "_mask", "_k0", "_k1", "_k2", *[c for c in SPEC_COLUMNS if c.startswith(("want", "lead"))])
    joined = expanded.join(spec_cols, ["_mask", "_k0", "_k1", "_k2"])
    pred = _spec_predicates(F.col("is_canceled"), F.col("reservation_status"),
                            F.col("is_repeated_guest"), F.col("total_of_special_requests") > 0,
                            F.col("required_car_parking_spaces") > 0, F.col("lead_time"))
    keep = [c for c in bk.columns]
    return joined.where(pred).select("spec_id", *keep).withColumnRenamed("spec_id", "gid")


# --------------------------------------------------------------------------
# 6. Metrics per group, long form
# --------------------------------------------------------------------------

# (metric, grouping key, measure, sub-key) of the keyed metrics computed in one GROUPING SETS pass
KEYED = [
    ("hotel_distribution", "hotel", "n", None),
    ("revenue_by_hotel", "hotel", "revenue", None),
    ("adr_by_hotel", "hotel", "adr_avg", None),
    ("stay_by_hotel", "hotel", "nights_avg", None),
    ("lead_time_by_hotel", "hotel", "lead_avg", None),
    ("bookings_by_month", "arrival_date_month", "n_canceled_nonnull", None),
    ("revenue_by_month", "arrival_date_month", "revenue", None),
    ("guests_by_segment", "market_segment", "guests", None),
    ("segment_distribution", "market_segment", "n", None),
    ("revenue_by_segment", "market_segment", "revenue", None),
    ("room_type_distribution", "reserved_room_type", "n", None),
    ("waitlist_distribution", "waitlist_category", "n", None),
    ("lead_time_distribution", "lead_time_category", "n", None),
    ("meal_distribution", "meal", "n", None),
    ("channel_distribution", "distribution_channel", "n", None),
    ("revenue_by_channel", "distribution_channel", "revenue", None),
    ("deposit_distribution", "deposit_type", "n", None),
    ("cancellation_by_deposit", "deposit_type", "canceled", "sum"),
    ("cancellation_by_deposit", "deposit_type", "n_canceled_nonnull", "count"),
    ("cancellation_by_deposit", "deposit_type", "rate", "rate"),
    ("cancellation_by_country", "country", "canceled", "sum"),
    ("cancellation_by_country", "country", "n_canceled_nonnull", "count"),
    ("cancellation_by_country", "country", "rate", "rate"),
    ("top_agents", "agent", "n", None),
    ("top_companies", "company", "n", None),
]
KEY_COLUMNS = ["hotel", "arrival_date_month", "market_segment", "reserved_room_type", "waitlist_category",
               "lead_time_category", "meal", "distribution_channel", "deposit_type", "country", "agent", "company"]


# sums and non-NULL counts that means are made of
_MEANS = ["revenue", "adr", "total_guests", "lead_time", "previous_bookings_not_canceled", "previous_cancellations",
          "booking_changes", "total_of_special_requests", "days_in_waiting_list", "stays_in_weekend_nights",
          "stays_in_week_nights", "total_nights"]
_MEDIANS = {"median_price": "adr", "median_lead_time": "lead_time", "median_stay": "total_nights"}


def scalar_partials(df: DataFrame, dims: list[str]) -> DataFrame:
    """Partial aggregates of all scalar metrics per ``dims``: they add up (or take min/max) over any union of groups."""
    weekend_only = (F.col("stays_in_weekend_nights") > 0) & (F.col("stays_in_week_nights") == 0)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in _MEANS:
        aggs += [F.sum(F.col(c).cast("double")).alias(f"s_{c}"), F.count(c).alias(f"k_{c}")]
    aggs += [F.sum(F.col(c).cast("long")).alias(f"s_{c}") for c in ("is_canceled", "is_repeated_guest")]
    aggs += [F.count_if(F.col(c) > 0).alias(f"p_{c}") for c in ("booking_changes", "total_of_special_requests", "days_in_waiting_list")]
    aggs += [F.count_if(differs("reserved_room_type", "assigned_room_type")).alias("rooms_changed"),
             F.count_if(weekend_only).alias("weekend_only"), F.min("adr").alias("lo_adr"), F.max("adr").alias("hi_adr"),
             F.max("total_nights").alias("hi_total_nights")]
    return df.groupBy(*dims).agg(*aggs)


def combine_scalars(tagged: DataFrame) -> DataFrame:
    """All scalar metrics but the medians per ``gid`` from partials."""
    how = lambda c: F.min(c) if c.startswith("lo_") else F.max(c) if c.startswith("hi_") else F.sum(c)
    t = tagged.groupBy("gid").agg(*[how(c).alias(c) for c in tagged.columns if c != "gid"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean = lambda c: F.try_divide(F.col(f"s_{c}"), F.col(f"k_{c}"))
    we, wk = mean("stays_in_weekend_nights"), mean("stays_in_week_nights")
    return t.select("gid", *[x.alias(k) for k, x in {
        "total_records": F.col("n"), "total_revenue": zero("s_revenue").cast("double"), "avg_revenue": mean("revenue"),
        "total_bookings": F.col("n"), "canceled_bookings": zero("s_is_canceled"), "cancellation_rate": ratio(zero("s_is_canceled"), "n"),
        "avg_price": mean("adr"), "min_price": F.col("lo_adr").cast("double"), "max_price": F.col("hi_adr").cast("double"),
        "avg_guests_per_booking": mean("total_guests"), "avg_lead_time": mean("lead_time"),
        "repeat_guests": zero("s_is_repeated_guest"), "repeat_rate": ratio(zero("s_is_repeated_guest"), "n"),
        "avg_previous_stays": mean("previous_bookings_not_canceled"), "avg_previous_cancellations": mean("previous_cancellations"),
        "room_change_rate": F.try_divide("rooms_changed", "n"),
        "bookings_with_changes": F.col("p_booking_changes"), "change_rate": ratio("p_booking_changes", "n"), "avg_changes": mean("booking_changes"),
        "bookings_with_requests": F.col("p_total_of_special_requests"), "request_rate": ratio("p_total_of_special_requests", "n"),
        "avg_requests": mean("total_of_special_requests"),
        "bookings_waitlisted": F.col("p_days_in_waiting_list"), "waitlist_rate": ratio("p_days_in_waiting_list", "n"),
        "avg_waitlist_days": mean("days_in_waiting_list"),
        "avg_weekend_nights": we, "avg_week_nights": wk, "weekend_ratio": ratio(we, we + wk),
        "weekend_only_stays": F.col("weekend_only"), "weekend_only_rate": F.try_divide("weekend_only", "n"),
        "avg_stay": mean("total_nights"), "max_stay": F.col("hi_total_nights").cast("double"),
    }.items()])


def value_partials(df: DataFrame, dims: list[str], columns: list[str]) -> DataFrame:
    """(dims, what, value, n): how often each value of ``columns`` occurs, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(*dims, F.explode(pairs).alias("p")).select(*dims, "p.what", "p.value").where("value is not null")
    return rows.groupBy(*dims, "what", "value").agg(F.count(F.lit(1)).alias("n"))


def keyed_partials(df: DataFrame, dims: list[str], keys: list[str]) -> DataFrame:
    """(dims, keyname, key, meal_country, sums): one GROUPING SETS pass over the keys that aren't dims, ``meal`` with its country."""
    extra = [k for k in keys if k not in dims]
    both = "meal" in extra and "country" in extra
    view = df.select(*dims, *[F.col(k).cast("string").alias(f"k_{k}") for k in extra], "is_canceled", "revenue", "adr",
                     "total_guests", "total_nights", "lead_time")
    base = ", ".join(dims)
    sets = [f"({base}, k_{k})" for k in extra] + ([f"({base}, k_country, k_meal)"] if both else [])
    if any(k in dims for k in keys):
        sets.append(f"({base})")
    names = [*dims, *(f"k_{k}" for k in extra)]
    flags = "".join(f", grouping(k_{k}) AS g_{k}" for k in extra)
    return df.sparkSession.sql(
        f"""SELECT {', '.join(names)}{flags}, count(1) AS n, count(is_canceled) AS n_canceled_nonnull,
              COALESCE(sum(is_canceled), 0) AS canceled, COALESCE(sum(revenue), 0) AS revenue, sum(adr) AS adr_s, count(adr) AS adr_k,
              COALESCE(sum(total_guests), 0) AS guests, sum(total_nights) AS nights_s, count(total_nights) AS nights_k,
              sum(lead_time) AS lead_s, count(lead_time) AS lead_k
            FROM {{v}} GROUP BY GROUPING SETS ({', '.join(sets)})""", v=view)


_SUMS = ["n", "n_canceled_nonnull", "canceled", "revenue", "adr_s", "adr_k", "guests", "nights_s", "nights_k", "lead_s", "lead_k"]


def combine_keyed(tagged: DataFrame, dims: list[str], keys: list[str]) -> DataFrame:
    """(gid, keyname, key, country, measures) of every non-NULL key; keyname ``meal of country`` has the country in ``country``."""
    extra = [k for k in keys if k not in dims]
    grouped = {k: F.col(f"g_{k}") == 0 for k in extra}
    none = F.lit(None).cast("string")
    item = lambda name, key, country=none: F.struct(F.lit(name).alias("keyname"), key.cast("string").alias("key"), country.cast("string").alias("country"))
    items = []
    for k in extra:
        only = all_of([grouped[j] if j == k else ~grouped[j] for j in extra])
        items.append(F.when(only, item(k, F.col(f"k_{k}"))))
    if "meal" in extra:
        if "country" in extra:
            items.append(F.when(grouped["meal"] & grouped["country"], item("meal of country", F.col("k_meal"), F.col("k_country"))))
        elif "country" in dims:
            items.append(F.when(all_of([grouped[j] if j == "meal" else ~grouped[j] for j in extra]), item("meal of country", F.col("k_meal"), F.col("country"))))
    base = all_of([~grouped[j] for j in extra])
    items += [F.when(base, item(k, F.col(k))) for k in keys if k in dims]
    long = tagged.select("gid", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("i"), *_SUMS)
    out = long.where("i.key is not null").groupBy("gid", F.col("i.keyname").alias("keyname"), F.col("i.key").alias("key"),
                                                  F.col("i.country").alias("country")).agg(*[F.sum(c).alias(c) for c in _SUMS])
    return (out.withColumns({f"{c}_avg": F.try_divide(F.col(f"{c}_s").cast("double"), F.col(f"{c}_k")) for c in ("adr", "nights", "lead")})
            .withColumn("rate", ratio("canceled", "n_canceled_nonnull")))


def scope_metrics(frame: DataFrame, wanted: set[str] | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """Every metric of the menu for every ``gid``: (gid, metric, sub, key, value, ord, is_int).

    With ``scopes`` the bookings ``frame`` is aggregated once to partials per class of bookings that share their scopes; only these
    meet the scopes. Without, ``frame`` bears its ``gid``. Three aggregates read the bookings: scalar partials, value
    counts for the medians (stored, as quantiles read them several times), and the keyed metrics (GROUPING SETS); each is left out if no
    wanted metric needs it.
    Top-k metrics and the twelve months are made on the small grouped output, never on raw rows.
    """
    # only the blocks some question triggers are computed (total_records always)
    keep = lambda m: wanted is None or m in wanted or m == "total_records"
    dims, tag = ["gid"], lambda df: df
    if scopes is not None:
        members, gids = scope_classes(frame, scopes)
        frame, dims, tag = _with_class(frame, members), ["_class"], lambda df: df.join(gids, "_class").drop("_class")
    int_metrics = {m for m, _, kind in RESULT_ORDER if kind == "int"}
    scal = combine_scalars(tag(scalar_partials(frame, dims)))
    scalar_long = scal.select("gid", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in scal.columns if n != "gid" and keep(n)
    ])).alias("m")).select("gid", "m.metric", "m.value")
    medians = {m: c for m, c in _MEDIANS.items() if keep(m)}
    if medians:
        values = tag(_staged(value_partials(frame, dims, list(medians.values())), "values"))
        mid = linear_quantiles(values, "value", {"q": 0.5}, ["gid", "what"], weight="n")
        name = F.element_at(F.create_map(*[F.lit(x) for m, c in medians.items() for x in (c, m)]), F.col("what"))
        # a group without any value has no median: NULL, as for the other metrics
        asked = scal.select("gid", F.explode(F.array(*[F.lit(m) for m in medians])).alias("metric"))
        scalar_long = scalar_long.unionByName(asked.join(mid.select("gid", name.alias("metric"), F.col("q").alias("value")), ["gid", "metric"], "left"))
    scalar_long = scalar_long.select(
        "gid", "metric", F.lit(None).cast("string").alias("sub"), F.lit(None).cast("string").alias("key"), "value",
        F.lit(0).alias("ord"), F.col("metric").isin(*int_metrics).alias("is_int"))

    keyed_entries = [e for e in KEYED if keep(e[0])]
    with_meals = keep("meal_preferences_by_country")
    key_cols = [k for k in KEY_COLUMNS if any(e[1] == k for e in keyed_entries) or (with_meals and k in ("country", "meal"))]
    if not key_cols:
        return scalar_long
    grouped = combine_keyed(tag(keyed_partials(frame, dims, key_cols)), dims, key_cols)
    entries = [F.when(F.col("keyname") == key, F.struct(
        F.lit(metric).alias("metric"), F.lit(sub).cast("string").alias("sub"), F.col("key").alias("key"),
        F.col(measure).cast("double").alias("value"), F.col("n").alias("_n"), F.col("canceled").alias("_c")))
        for metric, key, measure, sub in keyed_entries]
    out = scalar_long
    if entries:
        keyed = grouped.select("gid", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")) \
            .select("gid", "e.*")
        by_month = [m for m in ("bookings_by_month", "revenue_by_month") if keep(m)]
        if by_month:
            months = scal.select("gid", F.explode(F.array(*[F.lit(m) for m in by_month])).alias("metric")).select(
                "gid", "metric", F.explode(F.array(*[F.lit(m) for m in MONTHS])).alias("key"))
            known = keyed.where(F.col("metric").isin(*by_month))
            full = months.join(known, ["gid", "metric", "key"], "left").select(*keyed.columns)
            keyed = keyed.where(~F.col("metric").isin(*by_month)).unionByName(full)
        out = out.unionByName(_order_keyed(keyed))
    if with_meals:
        cells = grouped.where((F.col("keyname") == "meal of country") & F.col("country").isNotNull()).select(
            "gid", "country", F.col("key").alias("meal"), "n")
        out = out.unionByName(_meal_preferences(cells))
    return out


def _order_keyed(keyed: DataFrame) -> DataFrame:
    """Presentation order inside each dict and the top-k cuts of the service."""
    month_pos = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.col("key"))
    # one sort key per metric family -> a single window sort:
    # counts desc (value counts), value desc (sorted sums), cancelled desc (top countries),
    # calendar position (months), otherwise key asc (grouped dicts)
    desc_count = F.col("metric").isin("hotel_distribution", "room_type_distribution", "waitlist_distribution",
                                      "lead_time_distribution", "meal_distribution", "channel_distribution",
                                      "segment_distribution", "deposit_distribution", "top_agents", "top_companies")
    sort_key = (F.when(desc_count, -F.col("_n").cast("double"))
                .when(F.col("metric") == "guests_by_segment", -F.col("value"))
                .when(F.col("metric") == "cancellation_by_country", -F.col("_c").cast("double"))
                .when(F.col("metric").isin("bookings_by_month", "revenue_by_month"), month_pos.cast("double"))
                .otherwise(F.lit(0.0)))
    w = Window.partitionBy("gid", "metric", "sub").orderBy(sort_key, F.col("key").try_cast("double"), F.col("key"))
    ordered = keyed.withColumn("ord", F.row_number().over(w))
    top10 = F.col("metric").isin("top_agents", "top_companies", "cancellation_by_country")
    ordered = ordered.where(~top10 | (F.col("ord") <= 10))
    int_measure = F.col("metric").isin(
        "hotel_distribution", "room_type_distribution", "waitlist_distribution", "lead_time_distribution",
        "meal_distribution", "channel_distribution", "segment_distribution", "deposit_distribution",
        "top_agents", "top_companies") | F.col("sub").isin("sum", "count")
    # month counts are whole numbers unless a month is absent (then the whole dictionary holds floats)
    months = Window.partitionBy("gid", "metric", "sub")
    int_measure = int_measure | ((F.col("metric") == "bookings_by_month") & F.min(F.col("value").isNotNull()).over(months))
    return ordered.select("gid", "metric", "sub", "key", "value", "ord", F.coalesce(int_measure, F.lit(False)).alias("is_int"))


def _meal_preferences(cells: DataFrame) -> DataFrame:
    """meal x country counts of the five busiest countries, keyed (sub = meal, key = country)."""
    per_country = cells.groupBy("gid", "country").agg(F.sum("n").alias("_t"))
    w = Window.partitionBy("gid").orderBy(F.col("_t").desc(), F.col("country"))
    top = per_country.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= 5)
    meals = cells.groupBy("gid").agg(F.array_sort(F.collect_set("meal")).alias("_meals"))
    counts = cells.groupBy("gid", "country").agg(F.map_from_entries(F.collect_list(F.struct("meal", "n"))).alias("_m"))
    return (top.join(meals, "gid").join(counts, ["gid", "country"])
            .select("gid", "country", "ord", F.explode("_meals").alias("meal"), "_m")
            .select("gid", F.lit("meal_preferences_by_country").alias("metric"), F.col("meal").alias("sub"),
                    F.col("country").alias("key"),
                    F.coalesce(F.element_at("_m", F.col("meal")), F.lit(0)).cast("double").alias("value"),
                    "ord", F.lit(True).alias("is_int")))


# --------------------------------------------------------------------------
# 7. Answers
# --------------------------------------------------------------------------

def question_blocks(questions: DataFrame, text: str = "text", notebook: bool = False) -> DataFrame:
    """(qid, block) for every metric block a question triggers (substring rules)."""
    low = F.lower(F.col(text))
    entries = []
    for block, subs in BLOCK_TRIGGERS.items():
        if block in SERVICE_SKIPS_BLOCKS and not notebook:
            continue
        hit = F.lit(True) if not subs else _any([low.contains(s) for s in subs])
        entries.append(F.when(hit, F.lit(block)))
    entries.append(F.when(low.contains("cancel") & _any([low.contains(s) for s in LOCATION_TRIGGERS]),
                          F.lit("cancel_location")))
    return questions.select("qid", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("block"))


def analyse(bk: DataFrame, questions: DataFrame, whole: bool = True, notebook: bool = False,
            text: str = "text", checkpoint: bool = True,
            candidates: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run F5-F18 and the metric menu for a table of questions.

    Returns ``spec`` (qid -> spec_id + spec), ``scopes`` (spec_id -> filtered
    records + scope), ``metrics`` (qid-level long table of triggered metrics).
    """
    if candidates is not None and not whole:
        raise ValueError("candidate restriction is supported with the whole-table scope (whole=True)")
    spec = with_spec_id(question_spec(questions, text))
    if candidates is not None:
        # each question starts from its own candidate rows -> scopes per question
        spec = spec.withColumn("spec_id", candidate_spec_id())
    specs = distinct_specs(spec)
    if candidates is not None:
        matches = match_candidates(bk, spec, candidates)
    else:
        matches = match_specs(specs, booking_cells(bk))
    scopes = spec_scopes(matches)
    if checkpoint:
        scopes = _staged(scopes, "scopes")  # one row per distinct spec, read by several branches
    # blocks any question triggers (a handful of names from the question table; no booking scan)
    used_blocks = {r[0] for r in question_blocks(questions, text, notebook).select("block").distinct().collect()}
    wanted_metrics = {m for m, b, _ in RESULT_ORDER if b in used_blocks}
    if whole:
        st = scope_table(scopes)
        per_gid = scope_metrics(bk, wanted_metrics, st)
        link = st.select("spec_id", F.col("scope_id").alias("gid"))
    else:
        per_gid = scope_metrics(filtered_bookings(bk, specs), wanted_metrics)
        link = scopes.select("spec_id", F.col("spec_id").alias("gid"))
    if checkpoint:
        per_gid = _staged(per_gid, "scope-metrics")
    q = (spec.select("qid", "spec_id")
         .join(scopes.select("spec_id", "filtered_records"), "spec_id", "left")
         .join(link, "spec_id", "left")
         .where(F.col("filtered_records") > 0))
    blocks = question_blocks(questions, text, notebook)
    metric_block = bk.sparkSession.createDataFrame(
        [(m, b, i) for i, (m, b, _) in enumerate(RESULT_ORDER)], "metric string, block string, pos int")
    wanted = blocks.join(metric_block, "block")
    fixed = ["total_records", "filtered_records"]
    long = (q.join(per_gid.where(~F.col("metric").isin(*fixed)), "gid")
            .join(wanted, ["qid", "metric"])
            .select("qid", "metric", "sub", "key", "value", "ord", "is_int", "pos"))
    # total_records exists even when the scope selects nothing (then 0)
    totals = per_gid.where(F.col("metric") == "total_records").select("gid", F.col("value").alias("_t"))
    counts = q.join(totals, "gid", "left").select("qid", F.array(
        F.struct(F.lit("total_records").alias("metric"), F.coalesce("_t", F.lit(0.0)).alias("value"), F.lit(0).alias("pos")),
        F.struct(F.lit("filtered_records").alias("metric"), F.col("filtered_records").cast("double").alias("value"),
                 F.lit(1).alias("pos"))).alias("_a"))
    counts = counts.select("qid", F.explode("_a").alias("m")).select(
        "qid", F.col("m.metric").alias("metric"), F.lit(None).cast("string").alias("sub"),
        F.lit(None).cast("string").alias("key"), F.col("m.value").alias("value"), F.lit(0).alias("ord"),
        F.lit(True).alias("is_int"), F.col("m.pos").alias("pos"))
    metrics = long.unionByName(counts)
    if checkpoint:
        metrics = _staged(metrics, "answers")  # cuts the lineage: small text plans, a restart point
    return {"spec": spec, "scopes": scopes, "metrics": metrics, "questions": q}


def _staged(df: DataFrame, name: str) -> DataFrame:
    """Write a small result (bounded by questions x menu) to the shared checkpoint folder and read it back."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
