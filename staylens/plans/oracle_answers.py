"""DuckDB SQL of the answer texts (X4-X6), written out independently of the operators."""

from __future__ import annotations

#: The results in the service's order; how each prints.
RESULTS = """total_records int, filtered_records int, hotel_distribution dict, total_revenue float, avg_revenue float, revenue_by_hotel dict,
total_bookings int, canceled_bookings int, cancellation_rate float, cancellation_by_country nested, avg_price float, median_price float,
min_price float, max_price float, adr_by_hotel dict, bookings_by_month dict, revenue_by_month dict, avg_guests_per_booking float,
guests_by_segment dict, repeat_guests int, repeat_rate float, avg_previous_stays float, avg_previous_cancellations float,
room_type_distribution dict, room_change_rate float, bookings_with_changes int, change_rate float, avg_changes float,
bookings_with_requests int, request_rate float, avg_requests float, bookings_waitlisted int, waitlist_rate float, avg_waitlist_days float,
waitlist_distribution dict, meal_distribution dict, meal_preferences_by_country nested, channel_distribution dict, segment_distribution dict,
revenue_by_channel dict, revenue_by_segment dict, deposit_distribution dict, cancellation_by_deposit nested, avg_weekend_nights float,
avg_week_nights float, weekend_ratio float, weekend_only_stays int, weekend_only_rate float, top_agents dict, top_companies dict,
avg_stay float, median_stay float, max_stay int, stay_by_hotel dict"""
#: Dictionaries of counts.
COUNTED = ["hotel_distribution", "room_type_distribution", "waitlist_distribution", "meal_distribution", "channel_distribution", "segment_distribution",
           "deposit_distribution", "top_agents", "top_companies", "meal_preferences_by_country"]
#: The prompt around the context and the question.
PROMPT = ("\n            <s>[INST] You are a hotel data analyst assistant. Use only the information provided in the context to answer the question. "
          "Be specific, concise, and provide numerical results when available.\n\n            Context:\n            ", "\n            \n            Question: ",
          "\n            \n            Answer: [/INST]\n            ")


def _text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _digits(x: str, n: int) -> str:
    """``x`` with ``n`` decimals, its shortest decimal text rounded half up."""
    return f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, {n})) AS VARCHAR)"


def result_ctes(found: str) -> str:
    """CTE ``res``: the rows of ``found`` (qid, metric, sub, key, value, ord) with their place, kind, and number texts (exact, short)."""
    names = ", ".join(f"('{name}', '{kind}', {k})" for k, (name, kind) in enumerate(x.split() for x in RESULTS.split(",")))
    counted = ", ".join(f"'{c}'" for c in COUNTED)
    return f"""found AS ({found}),
typed AS (SELECT found.*, r.kind, r.pos, r.kind = 'int' OR metric IN ({counted}) OR COALESCE(sub IN ('sum', 'count'), false)
    OR (metric = 'bookings_by_month' AND count(value) OVER (PARTITION BY qid, metric) = 12) AS whole
  FROM found JOIN (VALUES {names}) AS r(metric, kind, pos) USING (metric)),
res AS (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN whole THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS exact,
  CASE WHEN value IS NULL THEN 'nan' WHEN whole THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE {_digits('value', 2)} END AS short,
  CASE sub WHEN 'sum' THEN 1 WHEN 'count' THEN 2 WHEN 'rate' THEN 3 ELSE 0 END AS sub_pos FROM typed)"""


#: Every question's results (CTE ``res``) as one JSON object.
JSON_SELECT = """SELECT qid, '{' || string_agg('"' || metric || '": ' || j, ', ' ORDER BY pos) || '}' AS result FROM (
  SELECT qid, metric, pos, COALESCE(exact, 'null') AS j FROM res WHERE key IS NULL
  UNION ALL SELECT qid, metric, pos, '{' || string_agg('"' || key || '": ' || COALESCE(exact, 'null'), ', ' ORDER BY ord) || '}' FROM res WHERE key IS NOT NULL AND sub IS NULL GROUP BY ALL
  UNION ALL SELECT qid, metric, pos, '{' || string_agg('"' || sub || '": {' || j || '}', ', ' ORDER BY sub_pos, sub) || '}' FROM (
    SELECT qid, metric, pos, sub, sub_pos, string_agg('"' || key || '": ' || COALESCE(exact, 'null'), ', ' ORDER BY ord) AS j FROM res WHERE sub IS NOT NULL GROUP BY ALL) GROUP BY qid, metric, pos)
GROUP BY qid"""


def context_select(questions: str) -> str:
    """Context and prompt per question of ``questions`` (qid, text), from CTE ``res``."""
    of = lambda m: f"max(value) FILTER (WHERE metric = '{m}' AND key IS NULL)"
    nl = "chr(10)"
    percent = lambda c: _digits(f"({c} * 100)", 1) + " || '%' || " + nl
    return f""", h AS (SELECT qid, lower(any_value(q.text)) AS low, CAST(CAST({of('total_records')} AS BIGINT) AS VARCHAR) AS total, CAST(CAST({of('filtered_records')} AS BIGINT) AS VARCHAR) AS filtered,
  {of('room_change_rate')} AS room_change, {of('bookings_with_requests')} AS asking, {of('request_rate')} AS asking_rate, {of('avg_requests')} AS asked_for
  FROM res JOIN {questions} q USING (qid) GROUP BY qid),
lines(qid, a, b, c, d, line) AS (
  SELECT qid, 0, 0, 0, '', 'Analysis based on ' || total || ' hotel booking records' || CASE WHEN total <> filtered THEN ' (initial filter matched ' || filtered || ' records)' ELSE '' END || ':' || {nl} || {nl} FROM h
  UNION ALL SELECT qid, 1, 1, 0, '', 'Hotel types in data:' || {nl} || string_agg('- ' || key || ': ' || short || ' bookings' || {nl}, '' ORDER BY ord) || {nl} FROM res WHERE metric = 'hotel_distribution' GROUP BY qid
  UNION ALL SELECT qid, 2, 0, 0, '', 'Room type distribution:' || {nl} || string_agg('- Type ' || key || ': ' || short || ' bookings' || {nl}, '' ORDER BY ord)
    || CASE WHEN room_change IS NULL THEN '' ELSE '- Room change rate: ' || {percent('room_change')} END || {nl}
    FROM res JOIN h USING (qid) WHERE metric = 'room_type_distribution' AND (contains(low, 'room') OR contains(low, 'type')) GROUP BY qid, room_change
  UNION ALL SELECT qid, 3, 0, 0, '', 'Special requests analysis:' || {nl} || '- Bookings with special requests: ' || CAST(CAST(asking AS BIGINT) AS VARCHAR) || {nl} || '- Special request rate: ' || {percent('asking_rate')}
    || '- Average requests per booking: ' || {_digits('asked_for', 2)} || {nl} || {nl} FROM h WHERE asking IS NOT NULL AND (contains(low, 'special') OR contains(low, 'request'))
  UNION ALL SELECT qid, 4, 0, 0, '', 'Analysis results:' || {nl} FROM h
  UNION ALL SELECT qid, 100 + pos, 0, 0, '', metric || ': ' || short || {nl} FROM res WHERE key IS NULL AND pos > 1
  UNION ALL SELECT DISTINCT qid, 100 + pos, 0, 0, '', metric || ':' || {nl} FROM res WHERE key IS NOT NULL AND pos > 2
  UNION ALL SELECT qid, 100 + pos, 1, ord, '', '  ' || key || ': ' || short || {nl} FROM res WHERE kind = 'dict' AND pos > 2
  UNION ALL SELECT qid, 100 + pos, 1, sub_pos, sub, '  ' || sub || ': {{' || string_agg(chr(39) || key || chr(39) || ': ' || COALESCE(exact, 'nan'), ', ' ORDER BY ord) || '}}' || {nl} FROM res WHERE kind = 'nested' GROUP BY qid, pos, sub_pos, sub),
ctx AS (SELECT qid, string_agg(line, '' ORDER BY a, b, c, d) AS context FROM lines GROUP BY qid)
SELECT qid, {_text(PROMPT[0])} || context || {_text(PROMPT[1])} || q.text || {_text(PROMPT[2])} AS prompt, context FROM ctx JOIN {questions} q USING (qid)"""
