"""Registered queries of the question path (F5-F18, X5-X8, E1) and structured analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import questions as Q
from ..operators import report as R
from ..operators import vectors as V
from ..operators.case_filters import match_cases
from ..sources.tables import read_table
from .catalog import bk, bk_stored, describe_sql, register, rounded
from .fixtures import PAIRS, STRUCTURED_CASES, expected_df, questions_df, questions_values_sql
from .oracle_answers import JSON_SELECT, context_select, result_ctes
from .oracle_questions import encoded_ctes, metric_ctes
from .sqltext import clean_ctes

SCOPE_DIMS = list(Q.SCOPE_COLUMNS)


def _spec_sql(source: str, key_cols: str) -> str:
    """DuckDB form of ``question_spec`` over ``source`` (text column ``text``)."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    lead = [f"CASE WHEN regexp_matches(text, '{p}') THEN {lo} END" for p, lo, _ in Q.LEAD_PATTERNS]
    lead_hi = [f"CASE WHEN regexp_matches(text, '{p}') THEN {hi} END" for p, _, hi in Q.LEAD_PATTERNS]
    return f"""SELECT {key_cols},
  CASE WHEN TRY_CAST(NULLIF(regexp_extract(text, '(\\d{{4}})', 1), '') AS INT) <> 0
       THEN TRY_CAST(NULLIF(regexp_extract(text, '(\\d{{4}})', 1), '') AS INT) END AS year,
  upper(substr(NULLIF(regexp_extract(text, '(?i)({months})', 1), ''), 1, 1))
    || lower(substr(NULLIF(regexp_extract(text, '(?i)({months})', 1), ''), 2, 20)) AS month,
  CASE WHEN contains(lower(text), 'resort') THEN 'Resort Hotel' WHEN contains(lower(text), 'city') THEN 'City Hotel' END AS hotel,
  CASE WHEN contains(lower(text), 'canceled') OR contains(lower(text), 'cancelled') THEN 1
       WHEN contains(lower(text), 'not canceled') OR contains(lower(text), 'not cancelled') THEN 0 END AS want_canceled,
  contains(lower(text), 'checked out') OR contains(lower(text), 'check-out') AS want_checkout,
  contains(lower(text), 'no-show') OR contains(lower(text), 'no show') AS want_noshow,
  CASE WHEN contains(lower(text), 'repeat') OR contains(lower(text), 'returning') THEN 1
       WHEN contains(lower(text), 'first time') OR contains(lower(text), 'new customer') THEN 0 END AS want_repeat,
  contains(lower(text), 'special request') AS want_requests,
  contains(lower(text), 'parking') AS want_parking,
  greatest({', '.join(lead)}) AS lead_lo,
  least({', '.join(lead_hi)}) AS lead_hi
FROM {source}"""


# --------------------------------------------------------------------------
# F5-F14 over every conversation turn (data-derived questions)
# --------------------------------------------------------------------------

@register("question_spec", _spec_sql("conversations", "conv_id, turn"))
def q_question_spec(spark, sf_dir):
    """Filter spec extracted from the whole text of every conversation turn."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return Q.question_spec(conv).select("conv_id", "turn", *Q.SPEC_COLUMNS)


# --------------------------------------------------------------------------
# F16/F17 for the fixed questions against the whole bookings table
# --------------------------------------------------------------------------

_MATCH_SQL = """m AS (
  SELECT q.qid, b.* FROM qs q JOIN bk b
    ON (q.year IS NULL OR b.arrival_date_year = q.year)
   AND (q.month IS NULL OR lower(b.arrival_date_month) = lower(q.month))
   AND (q.hotel IS NULL OR b.hotel = q.hotel)
   AND (q.want_canceled IS NULL OR b.is_canceled = q.want_canceled)
   AND (NOT q.want_checkout OR b.reservation_status = 'Check-Out')
   AND (NOT q.want_noshow OR b.reservation_status = 'No-Show')
   AND (q.want_repeat IS NULL OR b.is_repeated_guest = q.want_repeat)
   AND (NOT q.want_requests OR b.total_of_special_requests > 0)
   AND (NOT q.want_parking OR b.required_car_parking_spaces > 0)
   AND (q.lead_lo IS NULL OR (b.lead_time >= q.lead_lo AND b.lead_time <= q.lead_hi))),
sc AS (
  SELECT q.qid, CAST(COALESCE(s.n, 0) AS BIGINT) AS filtered_records,
""" + ",\n".join(
    f"    COALESCE(s.{d}_set, false) AS scope_{d}_set, CASE WHEN s.{d}_set THEN s.{d} END AS scope_{d}"
    for d in SCOPE_DIMS) + """
  FROM qs q LEFT JOIN (
    SELECT qid, count(*) AS n,
""" + ",\n".join(
    f"      (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) = 1 AS {d}_set, "
    f"CAST(min({c}) AS VARCHAR) AS {d}"
    for d, c in Q.SCOPE_COLUMNS.items()) + """
    FROM m GROUP BY qid) s USING (qid))
"""


def _question_cte() -> str:
    return clean_ctes() + ", qs AS (" + _spec_sql(questions_values_sql(), "qid, text") + "),\n" + _MATCH_SQL


def _question_scopes(spark, sf_dir) -> DataFrame:
    return _scopes_of(bk(spark, sf_dir), questions_df(spark))


def _scopes_of(rows: DataFrame, questions: DataFrame) -> DataFrame:
    spec = Q.with_spec_id(Q.question_spec(questions))
    scopes = Q.spec_scopes(Q.match_specs(Q.distinct_specs(spec), Q.booking_cells(rows)))
    return _named(spec, scopes)


def _named(spec: DataFrame, scopes: DataFrame) -> DataFrame:
    out = spec.select("qid", "spec_id").join(scopes, "spec_id", "left")
    cols = [F.coalesce(F.col("filtered_records"), F.lit(0)).cast("long").alias("filtered_records")]
    for d in SCOPE_DIMS:
        is_set = F.coalesce(F.col(f"scope_{d}_set"), F.lit(False))
        cols += [is_set.alias(f"scope_{d}_set"), F.when(is_set, F.col(f"scope_{d}")).alias(f"scope_{d}")]
    return out.select("qid", *cols)


@register("question_filter", _question_cte() + "SELECT * FROM sc")
def q_question_filter(spark, sf_dir):
    """F16 + F17 detection: rows each fixed question selects, and the unique year/month/country/hotel."""
    return _question_scopes(spark, sf_dir)


@register("question_scope", _question_cte() + "SELECT sc.qid, sc.filtered_records, CAST((SELECT count(*) FROM bk b WHERE "
          + " AND ".join(f"(NOT sc.scope_{d}_set OR CAST(b.{c} AS VARCHAR) = sc.scope_{d})"
                         for d, c in Q.SCOPE_COLUMNS.items())
          + ") AS BIGINT) AS total_records FROM sc WHERE sc.filtered_records > 0")
def q_question_scope(spark, sf_dir):
    """size of the widened scope on the whole table for every answered question."""
    res = Q.analyse(bk_stored(spark, sf_dir), questions_df(spark))
    m = res["metrics"].where(F.col("metric").isin("total_records", "filtered_records"))
    return m.groupBy("qid").agg(
        F.max(F.when(F.col("metric") == "filtered_records", F.col("value"))).cast("long").alias("filtered_records"),
        F.max(F.when(F.col("metric") == "total_records", F.col("value"))).cast("long").alias("total_records"))


_ALL_TEXTS = ("(SELECT conv_id || '/' || turn AS qid, text FROM conversations UNION ALL SELECT * FROM (VALUES "
              + ", ".join(f"('pair/{i}', '{t}')" for i, t in enumerate(PAIRS, 1)) + ") AS p(qid, text))")


@register("conversation_scope", clean_ctes() + ", qs AS (" + _spec_sql(_ALL_TEXTS, "qid, text") + "),\n" + _MATCH_SQL + "SELECT * FROM sc")
def q_conversation_scope(spark, sf_dir):
    """F5-F17 for every conversation turn and for pairs of texts whose specs differ in place only."""
    turns = read_table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("qid"), "text")
    pairs = spark.createDataFrame([(f"pair/{i}", t) for i, t in enumerate(PAIRS, 1)], "qid string, text string")
    return _scopes_of(bk(spark, sf_dir), turns.unionByName(pairs))


_SCOPED = "t AS (SELECT sc.qid, b.* FROM sc JOIN bk b ON sc.filtered_records > 0 AND " + " AND ".join(
    f"(NOT sc.scope_{d}_set OR CAST(b.{c} AS VARCHAR) = sc.scope_{d})" for d, c in Q.SCOPE_COLUMNS.items()) + ")"
_FOUND = """SELECT qid, metric, sub, key, ROUND(value, 6) AS value, CAST(ord AS INT) AS ord FROM (SELECT * FROM menu
  UNION ALL SELECT sc.qid, 'total_records', NULL, NULL, CAST(count(t.qid) AS DOUBLE), 0 FROM sc LEFT JOIN t USING (qid) WHERE sc.filtered_records > 0 GROUP BY sc.qid
  UNION ALL SELECT qid, 'filtered_records', NULL, NULL, CAST(filtered_records AS DOUBLE), 0 FROM sc WHERE filtered_records > 0)"""


@register("question_metrics", _question_cte() + ", " + _SCOPED + ", " + metric_ctes("t", "qs") + _FOUND)
def q_question_metrics(spark, sf_dir):
    """F16-F18 + metric menu: every triggered metric of every fixed question (long table)."""
    res = Q.analyse(bk_stored(spark, sf_dir), questions_df(spark))
    return rounded(res["metrics"].select("qid", "metric", "sub", "key", "value", "ord"))


_RESULTS = _question_cte() + ", " + _SCOPED + ", " + metric_ctes("t", "qs") + ", " + result_ctes(_FOUND)


@register("context_text", _RESULTS + context_select("qs"))
def q_context_text(spark, sf_dir):
    """X5 + X6: context block and prompt text of every answered fixed question (values rounded to 6 digits first)."""
    questions = questions_df(spark)
    res = Q.analyse(bk_stored(spark, sf_dir), questions)
    ctx = R.context_text(rounded(res["metrics"]), questions)
    return R.prompt_text(ctx, questions).join(ctx, "qid")


_TEMPLATE_CTES = _question_cte() + """, agg AS (
  SELECT sc.qid, sc.filtered_records, count(b.id) AS total, COALESCE(sum(b.is_canceled), 0) AS canceled,
    COALESCE(sum(b.revenue), 0) AS rev, avg(b.revenue) AS avgrev
  FROM sc LEFT JOIN bk b ON """ + " AND ".join(
    f"(NOT sc.scope_{d}_set OR CAST(b.{c} AS VARCHAR) = sc.scope_{d})" for d, c in Q.SCOPE_COLUMNS.items()) + """
  GROUP BY sc.qid, sc.filtered_records)"""

_TEMPLATE_SELECT = """SELECT q.qid, CASE WHEN a.filtered_records <= 0 THEN 'I couldn''t find any data matching your query criteria.'
  ELSE 'Based on the analysis of ' || CAST(a.total AS VARCHAR) || ' hotel bookings:' || chr(10)
    || CASE WHEN contains(lower(q.text), 'cancel') AND a.total > 0 THEN
         '- Total bookings: ' || CAST(a.total AS VARCHAR) || chr(10)
         || '- Cancelled bookings: ' || CAST(a.canceled AS VARCHAR) || chr(10)
         || '- Cancellation rate: ' || printf('%.2f', a.canceled * 100.0 / a.total) || '%' || chr(10) ELSE '' END
    || CASE WHEN contains(lower(q.text), 'revenue') AND a.total > 0 THEN
         '- Total revenue: $' || printf('%.2f', a.rev) || chr(10)
         || '- Average revenue per booking: $' || printf('%.2f', a.avgrev) || chr(10) ELSE '' END
  END AS answer
FROM qs q JOIN agg a USING (qid)"""

_TEMPLATE_SQL = _TEMPLATE_CTES + "\n" + _TEMPLATE_SELECT


def _keywords_sql() -> str:
    from .fixtures import EXPECTED_KEYWORDS

    rows = ", ".join(
        "('" + q.replace("'", "''") + "', [" + ", ".join("'" + k.replace("'", "''") + "'" for k in kws) + "])"
        for q, kws in EXPECTED_KEYWORDS.items())
    return f"(SELECT * FROM (VALUES {rows}) AS t(question, keywords))"


_SCORED = (", ta AS (" + _TEMPLATE_SELECT + "),\nscored AS ("
           + "SELECT q.text AS question, CASE WHEN ek.keywords IS NULL OR len(ek.keywords) = 0 THEN 0.0 "
           + "ELSE len(list_filter(ek.keywords, lambda k: contains(lower(COALESCE(ta.answer, '')), lower(k)))) "
           + "/ len(ek.keywords) END AS accuracy FROM ta JOIN qs q USING (qid) "
           + "LEFT JOIN " + _keywords_sql() + " ek ON ek.question = q.text)\n")
_KEYWORD_SQL = _TEMPLATE_CTES + _SCORED + "SELECT question, ROUND(accuracy, 6) AS accuracy FROM scored"
_ACCURACY_HIST_SQL = (_TEMPLATE_CTES + _SCORED + """, s AS (SELECT min(accuracy) AS lo, max(accuracy) AS hi FROM scored)
SELECT b.bin, ROUND(s.lo + (s.hi - s.lo) * b.bin / 10, 6) AS bin_start, ROUND(s.lo + (s.hi - s.lo) * (b.bin + 1) / 10, 6) AS bin_end,
  CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM s CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(10)) b LEFT JOIN (
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((accuracy - lo) * 10 / (hi - lo)), 9) END AS INT) AS bin, count(*) AS n
  FROM scored, s WHERE accuracy IS NOT NULL GROUP BY 1) c USING (bin)""")
_ACCURACY_SUMMARY_SQL = (_TEMPLATE_CTES + _SCORED + "SELECT ROUND(avg(accuracy), 6) AS avg_accuracy, "
                         "ROUND(min(accuracy), 6) AS min_accuracy, ROUND(max(accuracy), 6) AS max_accuracy FROM scored")


@register("template_answer", _TEMPLATE_SQL)
def q_template_answer(spark, sf_dir):
    """X7 + X8: rule-based answer of every fixed question (fixed sentence when nothing matched)."""
    questions = questions_df(spark)
    res = Q.analyse(bk_stored(spark, sf_dir), questions)
    return R.template_answer(res["metrics"], questions)


@register("keyword_accuracy", _KEYWORD_SQL)
def q_keyword_accuracy(spark, sf_dir):
    """E1 + E4: keyword accuracy of the template answers against the expected keywords."""
    questions = questions_df(spark)
    res = Q.analyse(bk_stored(spark, sf_dir), questions)
    answers = R.template_answer(res["metrics"], questions).join(questions, "qid").select(
        F.col("text").alias("question"), "answer")
    scored = R.keyword_accuracy(answers, expected_df(spark))
    return rounded(scored.select("question", "accuracy"))


# --------------------------------------------------------------------------
# Structured analytics (F1/F2 + F18): filters and metric names per case
# --------------------------------------------------------------------------

def case_tables(spark, cases=STRUCTURED_CASES) -> tuple[DataFrame, DataFrame]:
    """The cases (gid) and their conditions (gid, column, op, value)."""
    conds = [(i, c, op, str(v)) for i, (given, _) in enumerate(cases, 1) for c, x in given.items() for op, v in (x.items() if isinstance(x, dict) else [("eq", x)])]
    return (spark.createDataFrame([(i,) for i in range(1, len(cases) + 1)], "gid int"),
            spark.createDataFrame(conds, "gid int, column string, op string, value string"))


@register("case_filter", clean_ctes() + """, m AS (SELECT unnest(['ignore', 'empty']) AS mode)
SELECT mode, CAST(n_nationkey AS INT) AS case_id, CAST(count(*) AS BIGINT) AS n, ROUND(SUM(revenue), 4) AS revenue FROM m, nation JOIN bk ON country = n_name
  AND CASE n_nationkey % 3 WHEN 0 THEN hotel = 'Resort Hotel' WHEN 1 THEN lead_time > n_nationkey * 10 ELSE adr < 1000 AND total_of_special_requests > 1 END GROUP BY ALL
UNION ALL SELECT mode, CAST(100 + r_regionkey AS INT), CAST(count(*) AS BIGINT), ROUND(SUM(revenue), 4) FROM m, region JOIN bk ON lead_time > r_regionkey * 100 AND lead_time < r_regionkey * 100 + 150
WHERE mode = 'ignore' OR r_regionkey <> 0 GROUP BY ALL""")
def q_case_filter(spark, sf_dir):
    """F4 + F18: cases from a table (one per nation: equality and ranges; one per region: ranges, one on an unknown column), in two modes."""
    nation, region = (read_table(spark, sf_dir, t) for t in ("nation", "region"))
    k = F.col("n_nationkey").cast("int")
    text = lambda c: c.cast("string")
    cond = lambda column, op, value: F.struct(F.lit(column).alias("column"), F.lit(op).alias("op"), value.alias("value"))
    more = (F.when(k % 3 == 0, F.array(cond("hotel", "eq", F.lit("Resort Hotel")))).when(k % 3 == 1, F.array(cond("lead_time", "gt", text(k * 10))))
            .otherwise(F.array(cond("adr", "lt", F.lit("1000")), cond("total_of_special_requests", "gt", F.lit("1")))))
    by_nation = nation.select(k.alias("case_id"), F.explode(F.concat(F.array(cond("country", "eq", F.col("n_name"))), more)).alias("c"))
    r = F.col("r_regionkey").cast("int")
    by_region = region.select((100 + r).alias("case_id"), F.explode(F.concat(
        F.array(cond("lead_time", "gt", text(r * 100)), cond("lead_time", "lt", text(r * 100 + 150))),
        F.when(r == 0, F.array(cond("colour", "eq", F.lit("red")))).otherwise(F.array().cast("array<struct<column:string,op:string,value:string>>")))).alias("c"))
    specs = by_nation.union(by_region).select("case_id", "c.*")
    rows = bk(spark, sf_dir)
    met = [match_cases(rows, specs.select("case_id").distinct(), specs, mode).groupBy(F.lit(mode).alias("mode"), "case_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("revenue"), 4).alias("revenue")) for mode in ("ignore", "empty")]
    return rounded(met[0].union(met[1]))


_CASES_SQL = """(SELECT 1 AS qid, * FROM bk WHERE arrival_date_month = 'July' AND arrival_date_year = 1997
  UNION ALL SELECT 2, * FROM bk WHERE hotel = 'Resort Hotel' UNION ALL SELECT 3, * FROM bk UNION ALL SELECT 4, * FROM bk WHERE total_of_special_requests > 0
  UNION ALL SELECT 5, * FROM bk WHERE is_canceled = 1 UNION ALL SELECT 6, * FROM bk WHERE is_repeated_guest = 1)"""
_CASE_NAMES = """(SELECT * FROM (VALUES (1, 'revenue total_bookings'), (2, 'cancellation_rate total_bookings canceled_bookings'), (3, 'bookings_by_country top_countries'),
  (4, 'total_bookings special_requests_count'), (5, 'cancellations_by_country top_cancellation_locations'), (6, 'total_bookings repeat_guest_percentage')) AS c(qid, text))"""


@register("structured_analytics", clean_ctes() + f", t AS {_CASES_SQL}, cs AS {_CASE_NAMES}, " + metric_ctes("t", "cs") + """
SELECT qid AS case_id, metric, sub, key, ROUND(value, 6) AS value, CAST(ord AS INT) AS ord FROM (SELECT * FROM menu
  UNION ALL SELECT qid, m, NULL, NULL, CAST(count(*) AS DOUBLE), 0 FROM t, (VALUES ('total_records'), ('filtered_records')) AS x(m) GROUP BY qid, m)""")
def q_structured_analytics(spark, sf_dir):
    """the six structured cases, each its filter + the blocks its metric names trigger."""
    frame = match_cases(bk_stored(spark, sf_dir), *case_tables(spark), "ignore", "gid")
    cases = spark.createDataFrame([(i, " ".join(m)) for i, (_, m) in enumerate(STRUCTURED_CASES, 1)],
                                  "qid int, text string")
    blocks = Q.question_blocks(cases)
    used = {r[0] for r in blocks.select("block").distinct().collect()}
    metrics = Q.scope_metrics(frame, wanted={m for m, b, _ in Q.RESULT_ORDER if b in used})
    metric_block = spark.createDataFrame([(m, b) for m, b, _ in Q.RESULT_ORDER], "metric string, block string")
    wanted = blocks.join(metric_block, "block").select(F.col("qid").alias("gid"), "metric")
    picked = metrics.join(wanted, ["gid", "metric"])
    # direct scope: the analysed rows are the filtered rows, so filtered_records = total_records
    filtered = picked.where(F.col("metric") == "total_records").withColumn("metric", F.lit("filtered_records"))
    return rounded(picked.unionByName(filtered).select(
        F.col("gid").alias("case_id"), "metric", "sub", "key", "value", "ord"))


_CANDIDATES = (clean_ctes() + ", qs AS (" + _spec_sql(questions_values_sql(), "qid, text") + "), texts AS (" + describe_sql("text") + "),\n" + encoded_ctes("texts", "dv", "id") + ",\n"
               + encoded_ctes("qs", "qv", "qid") + """, hit AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY ROUND(dp / (qv_n.norm * dv_n.norm), 9) DESC, id) AS rank,
    dp / (qv_n.norm * dv_n.norm) AS score
  FROM (SELECT qid, id, sum(qv.c * dv.c) AS dp FROM qv JOIN dv USING (place) GROUP BY qid, id) JOIN qv_n USING (qid) JOIN dv_n USING (id)),
""")


@register("question_candidates", _CANDIDATES + _MATCH_SQL.replace("FROM qs q JOIN bk b\n    ON ", "FROM qs q JOIN hit ON hit.qid = q.qid AND hit.rank <= 500 JOIN bk b ON b.id = hit.id\n    AND ")
          + "SELECT * FROM sc")
def q_question_candidates(spark, sf_dir):
    """V1 -> V4 -> F15 -> F16 -> F17: the service's default path, from each question's 500 nearest bookings to its scope."""
    rows, questions = bk_stored(spark, sf_dir), questions_df(spark)
    index = V.token_hash_encoder(C.describe(rows), "description").select("id", "embedding")
    asked = V.token_hash_encoder(questions, "text", "query").select("qid", "query")
    near = V.topk_batch(index, asked, 500).select("qid", "id")
    spec = Q.question_spec(questions).withColumn("spec_id", Q.candidate_spec_id())
    return _named(spec, Q.spec_scopes(Q.match_candidates(rows, spec, near)))


@register("candidate_metrics", _CANDIDATES + _MATCH_SQL.replace("FROM qs q JOIN bk b\n    ON ", "FROM qs q JOIN hit ON hit.qid = q.qid AND hit.rank <= 500 JOIN bk b ON b.id = hit.id\n    AND ")
          + ", " + _SCOPED + ", " + metric_ctes("t", "qs") + _FOUND)
def q_candidate_metrics(spark, sf_dir):
    """The default path to its end: each question's 500 nearest bookings -> filters -> scope -> every triggered metric of the scope."""
    rows, questions = bk_stored(spark, sf_dir), questions_df(spark)
    index = V.token_hash_encoder(C.describe(rows), "description").select("id", "embedding")
    near = V.topk_batch(index, V.token_hash_encoder(questions, "text", "query").select("qid", "query"), 500).select("qid", "id")
    res = Q.analyse(rows, questions, candidates=near)
    return rounded(res["metrics"].select("qid", "metric", "sub", "key", "value", "ord"))


@register("booking_search", _CANDIDATES.rstrip(",\n") + """ SELECT hit.qid, hit.id, ROUND(score, 6) AS semantic_score, CAST(rank AS INT) AS rank, hotel, arrival_date_year, arrival_date_month, ROUND(adr, 6) AS adr
FROM hit JOIN bk USING (id) WHERE rank <= 20""")
def q_booking_search(spark, sf_dir):
    """V1 + V5: top-20 bookings with their rows and semantic_score for every fixed question."""
    rows = bk(spark, sf_dir)
    index = V.token_hash_encoder(C.describe(rows), "description").select("id", "embedding")
    hits = V.topk_batch(index, V.token_hash_encoder(questions_df(spark), "text", "query").select("qid", "query"), 20)
    return rounded(hits.select("qid", "id", F.col("score").alias("semantic_score"), F.col("rank").cast("int").alias("rank"))
                   .join(rows.select("id", "hotel", "arrival_date_year", "arrival_date_month", "adr"), "id"))


@register("answer_json", _RESULTS + "\n" + JSON_SELECT)
def q_answer_json(spark, sf_dir):
    """X4 + S7: each fixed question's triggered metrics as one JSON object (values rounded to 6 digits)."""
    questions = questions_df(spark)
    res = Q.analyse(bk_stored(spark, sf_dir), questions)
    return R.result_json(rounded(res["metrics"]))


@register("accuracy_summary", _ACCURACY_SUMMARY_SQL)
def q_accuracy_summary(spark, sf_dir):
    """E1 + E4: mean / min / max keyword accuracy of the template answers."""
    questions = questions_df(spark)
    res = Q.analyse(bk_stored(spark, sf_dir), questions)
    answers = R.template_answer(res["metrics"], questions).join(questions, "qid").select(
        F.col("text").alias("question"), "answer")
    return rounded(R.accuracy_summary(R.keyword_accuracy(answers, expected_df(spark))))


@register("accuracy_histogram", _ACCURACY_HIST_SQL)
def q_accuracy_histogram(spark, sf_dir):
    """10 equal-width bins of the template answers' keyword accuracy."""
    questions = questions_df(spark)
    res = Q.analyse(bk_stored(spark, sf_dir), questions)
    answers = R.template_answer(res["metrics"], questions).join(questions, "qid").select(
        F.col("text").alias("question"), "answer")
    return rounded(R.accuracy_histogram(R.keyword_accuracy(answers, expected_df(spark)), 10))
