"""Answer text (X5-X8), history summaries (H1-H2) and evaluation statistics.

Text is assembled per question from the long metric table with ordered
``collect_list`` + ``array_join``: the list of one question is bounded by the
metric menu times the category dictionaries, never by booking rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.quantiles import approx_quantile, equal_width_histogram, linear_quantiles, rank_quantiles
from ..functions.text import py_number
from ..sources.schema import MONTHS
from .questions import EMPTY_ANSWER, PROMPT_TEMPLATE, RESULT_ORDER

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

ANALYTICS_TYPES = ["analytics", "structured_analytics"]
QUESTION_TYPE = "question"
SUB_ORDER = ["sum", "count", "rate"]


def _fmt(value: Column, is_int: Column) -> Column:
    """Python-style value text: ints plain, floats ``%.2f``, missing ``nan``."""
    return (F.when(value.isNull() | F.isnan(value), F.lit("nan"))
            .when(is_int, value.cast("long").cast("string"))
            .otherwise(F.format_string("%.2f", value)))


def _repr(value: Column, is_int: Column) -> Column:
    """Python ``repr`` of a number inside a printed dict."""
    return (F.when(value.isNull() | F.isnan(value), F.lit("nan"))
            .when(is_int, value.cast("long").cast("string"))
            .otherwise(py_number(value)))


def _line(qid: Column, pos: int | Column, o1: int | Column, o2: Column | int, o3: Column | int, text: Column) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.struct(qid.alias("qid"), lit(pos).alias("pos"), lit(o1).alias("o1"), lit(o2).alias("o2"),
                    lit(o3).alias("o3"), text.alias("text"))


def _kinds() -> dict[str, str]:
    return {m: kind for m, _, kind in RESULT_ORDER}


def context_text(metrics: DataFrame, questions: DataFrame, text: str = "text") -> DataFrame:
    """The context block per answered question (qid, context).

    ``metrics`` is the long table of ``questions.analyse`` (triggered metrics only).
    """
    kinds = _kinds()
    kind = F.element_at(F.create_map(*[x for m, k in kinds.items() for x in (F.lit(m), F.lit(k))]), F.col("metric"))
    m = metrics.withColumn("kind", kind)
    q = F.col("qid")
    val = _fmt(F.col("value"), F.col("is_int"))

    # month dictionaries list all twelve months (absent -> nan, and then every value prints as a float)
    months = F.array(*[F.lit(x) for x in MONTHS])
    month_rows = m.where(F.col("metric").isin("bookings_by_month", "revenue_by_month"))
    month_dim = month_rows.select("qid", "metric").distinct().select(
        "qid", "metric", F.posexplode(months).alias("mpos", "key"))
    month_full = month_dim.join(month_rows.select("qid", "metric", "key", "value", "is_int"), ["qid", "metric", "key"], "left")
    w = Window.partitionBy("qid", "metric")
    month_full = month_full.withColumn(
        "is_int", F.coalesce(F.min(F.col("value").isNotNull()).over(w), F.lit(False)) & (F.col("metric") == "bookings_by_month"))
    month_lines = month_full.select(_line(q, 0, 1, 0, F.col("mpos"), F.concat(
        F.lit("  "), F.col("key"), F.lit(": "), _fmt(F.col("value"), F.col("is_int")), F.lit("\n"))).alias("l"), "metric")

    scalar = m.where(F.col("kind").isin("int", "float") & ~F.col("metric").isin("total_records", "filtered_records"))
    scalar_lines = scalar.select(_line(q, 0, 0, 0, 0, F.concat(F.col("metric"), F.lit(": "), val, F.lit("\n"))).alias("l"), "metric")

    dicts = m.where((F.col("kind") == "dict") & ~F.col("metric").isin("hotel_distribution", "bookings_by_month", "revenue_by_month"))
    dict_lines = dicts.select(_line(q, 0, 1, 0, F.col("ord"), F.concat(
        F.lit("  "), F.col("key"), F.lit(": "), val, F.lit("\n"))).alias("l"), "metric")
    headers = m.where(F.col("kind").isin("dict", "nested") & (F.col("metric") != "hotel_distribution")) \
        .select("qid", "metric").distinct() \
        .select(_line(q, 0, 0, 0, 0, F.concat(F.col("metric"), F.lit(":\n"))).alias("l"), "metric")

    nested = m.where(F.col("kind") == "nested")
    sub_pos = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SUB_ORDER]), F.col("sub")), F.lit(0))
    entry = F.struct(F.col("ord"), F.concat(F.lit("'"), F.col("key"), F.lit("': "), _repr(F.col("value"), F.col("is_int"))).alias("t"))
    nested_lines = nested.groupBy("qid", "metric", "sub").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), ", ").alias("body"),
        F.min(sub_pos).alias("sp")).select(
        _line(q, 0, 1, F.col("sp"), 0, F.concat(F.lit("  "), F.col("sub"), F.lit(": {"), F.col("body"), F.lit("}\n"))).alias("l"),
        "metric")

    order = F.create_map(*[x for i, (mm, _, _) in enumerate(RESULT_ORDER) for x in (F.lit(mm), F.lit(i))])
    body = (scalar_lines.unionByName(dict_lines).unionByName(headers).unionByName(nested_lines).unionByName(month_lines)
            .select(F.struct(F.col("l.qid").alias("qid"), (F.element_at(order, F.col("metric")) + 100).alias("pos"),
                             F.col("l.o1").alias("o1"), F.col("l.o2").alias("o2"), F.col("l.o3").alias("o3"),
                             F.col("l.text").alias("text")).alias("l")))

    # head: summary line, hotel list, room block, request block, "Analysis results:"
    piv = m.groupBy("qid").agg(*[
        F.max(F.when((F.col("metric") == n) & F.col("key").isNull(), F.col("value"))).alias(n)
        for n in ("total_records", "filtered_records", "room_change_rate", "bookings_with_requests",
                  "request_rate", "avg_requests")
    ])
    qt = questions.select("qid", F.lower(F.col(text)).alias("low"))
    piv = piv.join(qt, "qid")
    total = F.coalesce(F.col("total_records"), F.lit(0.0)).cast("long").cast("string")
    filtered = F.coalesce(F.col("filtered_records"), F.lit(0.0)).cast("long").cast("string")
    summary = F.concat(
        F.lit("Analysis based on "), total, F.lit(" hotel booking records"),
        F.when(total != filtered, F.concat(F.lit(" (initial filter matched "), filtered, F.lit(" records)"))).otherwise(F.lit("")),
        F.lit(":\n\n"))
    head = piv.select(_line(q, 0, 0, 0, 0, summary).alias("l"))
    hotels = m.where(F.col("metric") == "hotel_distribution")
    hotel_head = hotels.select("qid").distinct().select(_line(q, 1, 0, 0, 0, F.lit("Hotel types in data:\n")).alias("l"))
    hotel_lines = hotels.select(_line(q, 1, 1, 0, F.col("ord"), F.concat(
        F.lit("- "), F.col("key"), F.lit(": "), val, F.lit(" bookings\n"))).alias("l"))
    hotel_tail = hotels.select("qid").distinct().select(_line(q, 1, 2, 0, 0, F.lit("\n")).alias("l"))

    room_q = qt.where(F.col("low").contains("room") | F.col("low").contains("type")).select("qid")
    rooms = m.where(F.col("metric") == "room_type_distribution").join(room_q, "qid")
    room_head = rooms.select("qid").distinct().select(_line(q, 2, 0, 0, 0, F.lit("Room type distribution:\n")).alias("l"))
    room_lines = rooms.select(_line(q, 2, 1, 0, F.col("ord"), F.concat(
        F.lit("- Type "), F.col("key"), F.lit(": "), val, F.lit(" bookings\n"))).alias("l"))
    room_tail = piv.join(rooms.select("qid").distinct(), "qid").select(_line(q, 2, 2, 0, 0, F.concat(
        F.when(F.col("room_change_rate").isNotNull(), F.concat(
            F.lit("- Room change rate: "), F.format_string("%.1f", F.col("room_change_rate") * 100), F.lit("%\n")))
        .otherwise(F.lit("")), F.lit("\n"))).alias("l"))

    req = piv.where((F.col("low").contains("special") | F.col("low").contains("request"))
                    & F.col("bookings_with_requests").isNotNull())
    req_block = req.select(_line(q, 3, 0, 0, 0, F.concat(
        F.lit("Special requests analysis:\n- Bookings with special requests: "),
        F.col("bookings_with_requests").cast("long").cast("string"),
        F.lit("\n- Special request rate: "), F.format_string("%.1f", F.col("request_rate") * 100),
        F.lit("%\n- Average requests per booking: "), F.format_string("%.2f", F.col("avg_requests")),
        F.lit("\n\n"))).alias("l"))
    results = piv.select(_line(q, 99, 0, 0, 0, F.lit("Analysis results:\n")).alias("l"))

    lines = head
    for part in (hotel_head, hotel_lines, hotel_tail, room_head, room_lines, room_tail, req_block, results, body):
        lines = lines.unionByName(part)
    ordered = lines.groupBy(F.col("l.qid").alias("qid")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            F.col("l.pos"), F.col("l.o1"), F.col("l.o2"), F.col("l.o3"), F.col("l.text")))), lambda e: e["text"]),
            "").alias("context"))
    return ordered


def prompt_text(context: DataFrame, questions: DataFrame, text: str = "text") -> DataFrame:
    """The instruction prompt around context and question."""
    before, rest = PROMPT_TEMPLATE.split("{context}")
    middle, after = rest.split("{question}")
    return context.join(questions.select("qid", F.col(text).alias("_q")), "qid").select(
        "qid", F.concat(F.lit(before), F.col("context"), F.lit(middle), F.col("_q"), F.lit(after)).alias("prompt"))


def template_answer(metrics: DataFrame, questions: DataFrame, text: str = "text") -> DataFrame:
    """X7 + X8: the rule-based answer of every question (fixed sentence when nothing matched)."""
    piv = metrics.groupBy("qid").agg(*[
        F.max(F.when((F.col("metric") == n) & F.col("key").isNull(), F.col("value"))).alias(n)
        for n in ("total_records", "filtered_records", "total_bookings", "canceled_bookings", "cancellation_rate",
                  "total_revenue", "avg_revenue")
    ])
    qt = questions.select("qid", F.lower(F.col(text)).alias("low"))
    joined = qt.join(piv, "qid", "left")
    cancel = F.when(F.col("low").contains("cancel") & F.col("canceled_bookings").isNotNull(), F.concat(
        F.lit("- Total bookings: "), F.col("total_bookings").cast("long").cast("string"),
        F.lit("\n- Cancelled bookings: "), F.col("canceled_bookings").cast("long").cast("string"),
        F.lit("\n- Cancellation rate: "), F.format_string("%.2f", F.coalesce(F.col("cancellation_rate"), F.lit(0.0)) * 100),
        F.lit("%\n"))).otherwise(F.lit(""))
    revenue = F.when(F.col("low").contains("revenue") & F.col("total_revenue").isNotNull(), F.concat(
        F.lit("- Total revenue: $"), F.format_string("%.2f", F.col("total_revenue")),
        F.lit("\n- Average revenue per booking: $"), F.format_string("%.2f", F.col("avg_revenue")),
        F.lit("\n"))).otherwise(F.lit(""))
    answer = F.when(F.coalesce(F.col("filtered_records"), F.lit(0.0)) <= 0, F.lit(EMPTY_ANSWER)).otherwise(F.concat(
        F.lit("Based on the analysis of "), F.coalesce(F.col("total_records"), F.lit(0.0)).cast("long").cast("string"),
        F.lit(" hotel bookings:\n"), cancel, revenue))
    return joined.select("qid", answer.alias("answer"))


# --------------------------------------------------------------------------
# History (H1-H2) and evaluation
# --------------------------------------------------------------------------

def query_mix(history: DataFrame) -> DataFrame:
    """H1 + H2: total, analytics and question counts, mean processing time."""
    return history.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col("query_type").isin(*ANALYTICS_TYPES)).alias("analytics_queries"),
        F.count_if(F.col("query_type") == QUESTION_TYPE).alias("questions"),
        F.coalesce(F.avg("processing_time"), F.lit(0.0)).alias("avg_response_time"),
    )


def recent_questions(history: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` questions."""
    q = history.where(F.col("query_type") == QUESTION_TYPE)
    return q.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n).select("id", "timestamp", "query")


def latency_summary(runs: DataFrame, approx: bool = False) -> DataFrame:
    """E2 + E4: test counts and response-time mean/median/min/max over successful runs."""
    ok = F.col("status_code") == 200
    t = F.when(ok, F.col("response_time"))
    median = approx_quantile(t, 0.5) if approx else linear_quantiles(runs.where(ok), "response_time", {"m": 0.5}).scalar()
    out = runs.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(ok).alias("successful_tests"),
        F.count_if(~ok).alias("failed_tests"),
        F.avg(t).alias("avg_response_time"),
        *([median.alias("median_response_time")] if approx else []),
        F.min(t).alias("min_response_time"),
        F.max(t).alias("max_response_time"),
    )
    out = out if approx else out.withColumn("median_response_time", median)
    return out.select("total_tests", "successful_tests", "failed_tests", "avg_response_time", "median_response_time",
                      "min_response_time", "max_response_time")


def latency_percentiles(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """p90 / p95 as ``sorted(times)[int(q * n)]`` over successful runs (per group)."""
    ok = runs.where(F.col("status_code") == 200)
    return rank_quantiles(ok, "response_time", {"p90": 0.9, "p95": 0.95}, by)


def first_result_per_question(runs: DataFrame) -> DataFrame:
    """E5: the first recorded response time of each question (by sequence)."""
    return runs.groupBy("question").agg(
        F.min_by("response_time", "seq").alias("first_response_time"), F.min("seq").alias("first_seq"))


def time_histogram(runs: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width histogram of successful response times."""
    return equal_width_histogram(runs.where(F.col("status_code") == 200), "response_time", bins)


def keyword_accuracy(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of a question's expected keywords found in its answer (case-insensitive).

    ``answers`` (question, answer), ``expected`` (question, keywords ARRAY<STRING>);
    a question without expected keywords scores 0.
    """
    joined = answers.join(expected, "question", "left")
    low = F.lower(F.coalesce(F.col("answer"), F.lit("")))
    found = F.size(F.filter("keywords", lambda k: low.contains(F.lower(k))))
    known = F.col("keywords").isNotNull() & (F.size("keywords") > 0)
    return joined.select("question", "answer",
                         F.when(known, ratio(found, F.size("keywords"))).otherwise(F.lit(0.0)).alias("accuracy"))


def accuracy_summary(scored: DataFrame) -> DataFrame:
    """Mean / min / max accuracy."""
    return scored.agg(F.avg("accuracy").alias("avg_accuracy"), F.min("accuracy").alias("min_accuracy"),
                      F.max("accuracy").alias("max_accuracy"))


def result_json(metrics: DataFrame) -> DataFrame:
    """Every question's triggered metrics as one JSON object (qid, result).

    Scalars become numbers, keyed metrics objects ``{key: value}``, nested
    metrics ``{sub: {key: value}}`` (the API's dict-of-dicts), NaN -> null.
    Built with ordered ``collect_list`` per (qid, metric) and per qid.
    """
    num = F.when(F.col("value").isNull() | F.isnan("value"), F.lit("null")) \
        .when(F.col("is_int"), F.col("value").cast("long").cast("string")).otherwise(py_number("value"))
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    entry = F.struct(F.col("ord"), F.concat(quoted(F.col("key")), F.lit(": "), num).alias("t"))
    obj = lambda parts: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(parts), lambda e: e["t"]), ", "), F.lit("}"))
    scal = metrics.where(F.col("key").isNull()).select("qid", "metric", "pos", num.alias("j"))
    flat = metrics.where(F.col("key").isNotNull() & F.col("sub").isNull()).groupBy("qid", "metric") \
        .agg(F.min("pos").alias("pos"), obj(F.collect_list(entry)).alias("j"))
    inner = metrics.where(F.col("key").isNotNull() & F.col("sub").isNotNull()).groupBy("qid", "metric", "sub") \
        .agg(F.min("pos").alias("pos"), obj(F.collect_list(entry)).alias("j"))
    sub_pos = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SUB_ORDER]), F.col("sub")), F.lit(0))
    nested = inner.groupBy("qid", "metric").agg(F.min("pos").alias("pos"), obj(F.collect_list(F.struct(
        sub_pos.alias("o"), F.concat(quoted(F.col("sub")), F.lit(": "), F.col("j")).alias("t")))).alias("j"))
    parts = scal.unionByName(flat).unionByName(nested)
    return parts.groupBy("qid").agg(obj(F.collect_list(F.struct(
        F.col("pos"), F.concat(quoted(F.col("metric")), F.lit(": "), F.col("j")).alias("t")))).alias("result"))


def accuracy_histogram(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width histogram of accuracy scores."""
    return equal_width_histogram(scored, "accuracy", bins)
