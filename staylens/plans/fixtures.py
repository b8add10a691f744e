"""Question fixtures of the original evaluator (fixed values).

The year 2017 of the original data is replaced by 1997, a year present in the
driver's tables. These small lists are workload parameters: every registered
query joins them with the whole bookings table, so the work grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

QUESTIONS = [
    "What was the total revenue for July 1997?",
    "What's the cancellation rate for resort hotels?",
    "Which country has the highest number of bookings?",
    "How many bookings include special requests?",
    "Which countries had the highest booking cancellations?",
    "What percentage of bookings are from repeat guests?",
    "What is the average price of hotel bookings?",
]

ANALYTICS_SENTENCES = [
    "Show me the revenue trends for 1997",
    "What's the monthly cancellation rate for resort hotels?",
    "Compare the average daily rate between city and resort hotels",
    "Which countries contribute the most to our revenue?",
    "What's the typical stay duration for guests with children?",
]

EXPECTED_KEYWORDS = {
    "What was the total revenue for July 1997?": ["revenue", "july", "1997", "$"],
    "What's the cancellation rate for resort hotels?": ["cancellation", "rate", "resort", "percent", "%"],
    "Which country has the highest number of bookings?": ["country", "bookings", "highest"],
    "How many bookings include special requests?": ["special requests", "bookings"],
    "Which countries had the highest booking cancellations?": ["location", "cancellations", "most", "highest"],
    "What percentage of bookings are from repeat guests?": ["repeat guests", "percentage", "bookings"],
    "What is the average price of hotel bookings?": ["average", "price", "bookings"],
}

# structured analytics cases: (filters, metric names); metric names are joined by blanks
# and matched by trigger substrings like a question
STRUCTURED_CASES = [
    ({"arrival_date_month": "July", "arrival_date_year": 1997}, ["revenue", "total_bookings"]),
    ({"hotel": "Resort Hotel"}, ["cancellation_rate", "total_bookings", "canceled_bookings"]),
    ({}, ["bookings_by_country", "top_countries"]),
    ({"total_of_special_requests": {"gt": 0}}, ["total_bookings", "special_requests_count"]),
    ({"is_canceled": 1}, ["cancellations_by_country", "top_cancellation_locations"]),
    ({"is_repeated_guest": 1}, ["total_bookings", "repeat_guest_percentage"]),
]


#: Texts whose specs hold the same values in different places.
PAIRS = [
    "How many cancelled bookings were there?", "How many first time guests checked out?", "cancelled no-show bookings",
    "repeat guests that checked out", "returning guests with parking", "cancelled bookings with parking", "July 1997 in the city",
    "1997 resort special request", "early resort bookings", "last minute city no show",
]


def all_questions() -> list[str]:
    return QUESTIONS + ANALYTICS_SENTENCES


def questions_df(spark: SparkSession) -> DataFrame:
    """(qid, text) of the fixed questions."""
    return spark.createDataFrame(list(enumerate(all_questions(), start=1)), "qid int, text string")


def expected_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXPECTED_KEYWORDS.items()), "question string, keywords array<string>")


def questions_values_sql() -> str:
    """The fixed questions as a DuckDB VALUES table ``questions_fx(qid, text)``."""
    rows = ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in enumerate(all_questions(), start=1))
    return f"(SELECT * FROM (VALUES {rows}) AS t(qid, text))"
