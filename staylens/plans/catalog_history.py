"""Registered history (H1-H2, L5) and evaluation (E2-E6) queries over ``events``, and the generator.

Stand-in mapping of ``events`` (rows only, no work): query_history.query_type
from event_type (view -> question, click -> analytics, purchase ->
structured_analytics, signup -> booking, error -> error), processing_time =
value; evaluation runs: seq = event_id, kind = event_type, question = the
user's key, status 500 for error events else 200, response_time = value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report as R
from ..sources.generator import generate_bookings
from ..sources.tables import read_table
from .catalog import register, rounded

_TYPE = {"view": "question", "click": "analytics", "purchase": "structured_analytics", "signup": "booking",
         "error": "error"}


def history(spark, sf_dir) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    qtype = F.element_at(F.create_map(*[x for k, v in _TYPE.items() for x in (F.lit(k), F.lit(v))]), F.col("event_type"))
    return ev.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("props").alias("query"),
                     qtype.alias("query_type"), F.lit(None).cast("string").alias("response"),
                     F.col("value").alias("processing_time"))


def runs(spark, sf_dir) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"),
                     F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("question"),
                     F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
                     F.col("value").alias("response_time"))


_HIST_SQL = """(SELECT event_id AS id, ts AS timestamp, props AS query,
  CASE event_type WHEN 'view' THEN 'question' WHEN 'click' THEN 'analytics' WHEN 'purchase' THEN 'structured_analytics'
    WHEN 'signup' THEN 'booking' WHEN 'error' THEN 'error' END AS query_type, value AS processing_time FROM events)"""
_RUNS_SQL = """(SELECT event_id AS seq, event_type AS kind, 'user-' || CAST(user_id AS VARCHAR) AS question,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS response_time FROM events)"""


@register("recent_history", f"SELECT id, timestamp, query FROM {_HIST_SQL} WHERE query_type = 'question' "
          "ORDER BY timestamp DESC, id DESC LIMIT 10")
def q_recent_history(spark, sf_dir):
    """L4 + L5: the ten newest questions of the query history."""
    return R.recent_questions(history(spark, sf_dir), 10)


@register("query_mix", f"""SELECT CAST(count(*) AS BIGINT) AS total_queries,
  CAST(count(*) FILTER (WHERE query_type IN ('analytics', 'structured_analytics')) AS BIGINT) AS analytics_queries,
  CAST(count(*) FILTER (WHERE query_type = 'question') AS BIGINT) AS questions,
  ROUND(COALESCE(avg(processing_time), 0), 6) AS avg_response_time FROM {_HIST_SQL}""")
def q_query_mix(spark, sf_dir):
    """H1 + H2: query counts by kind and mean processing time."""
    return rounded(R.query_mix(history(spark, sf_dir)))


@register("latency_summary", f"""SELECT CAST(count(*) AS BIGINT) AS total_tests,
  CAST(count(*) FILTER (WHERE status_code = 200) AS BIGINT) AS successful_tests,
  CAST(count(*) FILTER (WHERE status_code <> 200) AS BIGINT) AS failed_tests,
  ROUND(avg(response_time) FILTER (WHERE status_code = 200), 6) AS avg_response_time,
  ROUND(quantile_cont(response_time, 0.5) FILTER (WHERE status_code = 200), 6) AS median_response_time,
  ROUND(min(response_time) FILTER (WHERE status_code = 200), 6) AS min_response_time,
  ROUND(max(response_time) FILTER (WHERE status_code = 200), 6) AS max_response_time FROM {_RUNS_SQL}""")
def q_latency_summary(spark, sf_dir):
    """E2 + E4: test counts, mean / median / min / max response time of successful runs."""
    return rounded(R.latency_summary(runs(spark, sf_dir)))


@register("latency_p90", f"""SELECT kind, CAST(count(*) AS BIGINT) AS n,
  ROUND(list_sort(list(response_time))[CAST(floor(0.9 * count(*)) AS BIGINT) + 1], 6) AS p90,
  ROUND(list_sort(list(response_time))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1], 6) AS p95
FROM {_RUNS_SQL} WHERE status_code = 200 AND response_time IS NOT NULL GROUP BY kind""")
def q_latency_p90(spark, sf_dir):
    """p90 / p95 per run kind with the evaluator's rule sorted[int(q * n)]."""
    return rounded(R.latency_percentiles(runs(spark, sf_dir), ["kind"]))


@register("first_response", f"""SELECT question, ROUND(arg_min(response_time, seq), 6) AS first_response_time,
  min(seq) AS first_seq FROM {_RUNS_SQL} GROUP BY question""")
def q_first_response(spark, sf_dir):
    """E5: first recorded response time of every question."""
    return rounded(R.first_result_per_question(runs(spark, sf_dir)))


@register("time_histogram", f"""WITH r AS (SELECT response_time AS x FROM {_RUNS_SQL} WHERE status_code = 200),
s AS (SELECT min(x) AS lo, max(x) AS hi FROM r)
SELECT b.bin, ROUND(s.lo + (s.hi - s.lo) * b.bin / 10, 6) AS bin_start, ROUND(s.lo + (s.hi - s.lo) * (b.bin + 1) / 10, 6) AS bin_end,
  CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM s CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(10)) b LEFT JOIN (
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) * 10 / (hi - lo)), 9) END AS INT) AS bin, count(*) AS n
  FROM r, s WHERE x IS NOT NULL GROUP BY 1) c USING (bin)""")
def q_time_histogram(spark, sf_dir):
    """10 equal-width bins of successful response times."""
    return rounded(R.time_histogram(runs(spark, sf_dir), 10))


@register("generate_bookings", None)
def q_generate_bookings(spark, sf_dir):
    """One synthetic booking (original choice sets and ranges) per order row."""
    seeds = read_table(spark, sf_dir, "orders").select("o_orderkey")
    out = generate_bookings(seeds, "o_orderkey", seed=42, today="2024-01-01")
    return rounded(out.select("id", "hotel", "arrival_date_month", "adr", "total_nights", "revenue",
                              "waitlist_category", "reservation_status"))
