"""Question specs, batch answering and scope widening."""

from pyspark.sql import functions as F

from staylens.operators import questions as Q
from staylens.operators import report as R


def _spec(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "qid int, text string")
    return Q.question_spec(df, **kw).first()


def test_spec_extraction(spark):
    s = _spec(spark, "What was the total revenue for July 1997 at the resort, last-minute?")
    assert s["year"] == 1997 and s["month"] == "July" and s["hotel"] == "Resort Hotel"
    assert (s["lead_lo"], s["lead_hi"]) == (0, 7)
    s = _spec(spark, "cancelled bookings made early with parking, no show, repeat guests in CITY")
    assert s["want_canceled"] == 1 and s["want_parking"] and s["want_noshow"] and s["want_repeat"] == 1
    assert s["hotel"] == "City Hotel" and (s["lead_lo"], s["lead_hi"]) == (90, 1000)
    # the negated branch is unreachable in parity mode, reachable with fix_negation
    assert _spec(spark, "not cancelled")["want_canceled"] == 1
    assert _spec(spark, "not cancelled", fix_negation=True)["want_canceled"] == 0
    assert _spec(spark, "year 0000 data")["year"] is None


def _answers(spark, bk, texts):
    qs = spark.createDataFrame(list(enumerate(texts, 1)), "qid int, text string")
    res = Q.analyse(bk, qs)
    return {r["qid"]: r["answer"] for r in R.template_answer(res["metrics"], qs).collect()}, res


def test_batch_equals_one_by_one(spark, sf_small):
    from staylens.plans.catalog import bk
    from staylens.plans.fixtures import all_questions
    b = bk(spark, sf_small).cache()
    texts = all_questions()
    batch, _ = _answers(spark, b, texts)
    for i, t in enumerate(texts[:4], 1):
        single, _ = _answers(spark, b, [t])
        assert single[1] == batch[i]
    b.unpersist()


def test_scope_widening_against_pandas(spark, sf_small):
    """F16/F17 versus a direct pandas computation of the service's rules."""
    from staylens.plans.catalog import bk
    b = bk(spark, sf_small)
    pdf = b.toPandas()
    text = "What was the total revenue for July 1997?"
    _, res = _answers(spark, b, [text])
    got = {r["metric"]: r["value"] for r in res["metrics"].where(F.col("key").isNull()).collect()}
    f = pdf[(pdf.arrival_date_year == 1997) & (pdf.arrival_date_month.str.lower() == "july")]
    scope = pdf.copy()
    for col in ["arrival_date_year", "arrival_date_month", "country", "hotel"]:
        if f[col].nunique(dropna=False) == 1:
            scope = scope[scope[col] == f[col].iloc[0]]
    assert got["filtered_records"] == len(f)
    assert got["total_records"] == len(scope)
    assert abs(got["total_revenue"] - scope.revenue.sum()) < 1e-6


def test_empty_answer(spark, sf_small):
    from staylens.plans.catalog import bk
    ans, _ = _answers(spark, bk(spark, sf_small), ["revenue for July 1900"])
    assert ans[1] == Q.EMPTY_ANSWER


def test_context_text_shape(spark, sf_small):
    from staylens.plans.catalog import bk
    qs = spark.createDataFrame([(1, "What's the cancellation rate for resort hotels?")], "qid int, text string")
    res = Q.analyse(bk(spark, sf_small), qs)
    ctx = R.context_text(res["metrics"], qs).first()["context"]
    assert ctx.startswith("Analysis based on ")
    assert "Hotel types in data:\n- Resort Hotel: " in ctx
    assert "Analysis results:\ntotal_bookings: " in ctx and "cancellation_rate: 0." in ctx


def test_candidate_restriction(spark, sf_small):
    """a question restricted to candidate ids sees only those rows before filtering."""
    from staylens.plans.catalog import bk
    b = bk(spark, sf_small).cache()
    july = b.where("arrival_date_year = 1997 AND arrival_date_month = 'July'").select("id").limit(5)
    ids = [r.id for r in july.collect()]
    qs = spark.createDataFrame([(1, "revenue for July 1997")], "qid int, text string")
    cands = spark.createDataFrame([(1, i) for i in ids + [-1]], "qid int, id long")
    res = Q.analyse(b, qs, candidates=cands)
    got = {r["metric"]: r["value"] for r in res["metrics"].where(F.col("key").isNull()).collect()}
    assert got["filtered_records"] == len(ids)
    whole = b.where("arrival_date_year = 1997 AND arrival_date_month = 'July'")
    # the widened scope is the unique year/month/(country/hotel when unique) on the whole table
    assert got["total_records"] <= whole.count()
    b.unpersist()


def test_result_json_parses(spark, sf_small):
    import json
    from staylens.plans.catalog import bk
    qs = spark.createDataFrame([(1, "cancellation by country and deposit, monthly revenue")], "qid int, text string")
    res = Q.analyse(bk(spark, sf_small), qs)
    doc = json.loads(R.result_json(res["metrics"]).first()["result"])
    assert doc["total_records"] == doc["filtered_records"] > 0
    assert set(doc["cancellation_by_deposit"]) == {"sum", "count", "rate"}
    assert len(doc["revenue_by_month"]) <= 12 and isinstance(doc["hotel_distribution"], dict)


def test_numbers_print_as_in_python(spark):
    from staylens.functions.text import py_number
    values = [0.0, -0.0, 1.0, 0.5, 123456.789, 9999999.0, 1e7, 12345678.9, -98765432.125, 1e15, 9007199254740993.0, 1e16, 1.5e17, 1e-3, 5e-4, -1.25e-4, 1e-4, 5e-5, 1.5e-10, 0.00012345678901234567]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(py_number("v").alias("t")).collect()]
    assert got == [repr(v) for v in values]
    assert spark.range(1).select(py_number(F.lit(float("nan"))).alias("t")).first().t is None


def test_direct_scope_analyses_filtered_rows(spark, sf_small):
    """without widening, the analysed rows are exactly the filtered rows."""
    from staylens.plans.catalog import bk
    b = bk(spark, sf_small)
    qs = spark.createDataFrame([(1, "cancelled bookings at the resort with special requests")], "qid int, text string")
    res = Q.analyse(b, qs, whole=False)
    got = {r["metric"]: r["value"] for r in res["metrics"].where(F.col("key").isNull()).collect()}
    want = b.where("is_canceled = 1 AND hotel = 'Resort Hotel' AND total_of_special_requests > 0").count()
    assert got["filtered_records"] == got["total_records"] == want


def test_notebook_lead_block(spark, sf_small):
    """M13 (notebook engine): 'lead' questions get lead-time statistics and the bin distribution."""
    from staylens.plans.catalog import bk
    b = bk(spark, sf_small)
    qs = spark.createDataFrame([(1, "average lead time in July 1997")], "qid int, text string")
    service = {r["metric"] for r in Q.analyse(b, qs)["metrics"].collect()}
    notebook = Q.analyse(b, qs, notebook=True)["metrics"]
    names = {r["metric"] for r in notebook.collect()}
    assert "avg_lead_time" not in service and {"avg_lead_time", "median_lead_time", "lead_time_distribution",
                                                "lead_time_by_hotel"} <= names
    july = b.where("arrival_date_year = 1997 AND arrival_date_month = 'July'")
    got = {r["key"]: r["value"] for r in notebook.where("metric = 'lead_time_distribution'").collect()}
    want = {r["lead_time_category"]: r["n"] for r in july.where("lead_time_category IS NOT NULL")
            .groupBy("lead_time_category").count().withColumnRenamed("count", "n").collect()}
    assert got == want


def test_different_specs_never_share_an_id(spark):
    """Every pair of trigger texts: one spec id for equal spec columns, different ids for different ones."""
    import itertools

    bits = ["July", "1997", "resort", "city", "cancelled", "checked out", "no show", "repeat", "first time", "special request", "parking", "last minute", "early"]
    texts = [" ".join(c) for n in (0, 1, 2, 3) for c in itertools.combinations(bits, n)]
    rows = Q.with_spec_id(Q.question_spec(spark.createDataFrame(list(enumerate(texts)), "qid int, text string"))).collect()
    by_id, by_columns = {}, {}
    for r in rows:
        columns = tuple(r[c] for c in Q.SPEC_COLUMNS)
        assert by_id.setdefault(r["spec_id"], columns) == columns and by_columns.setdefault(columns, r["spec_id"]) == r["spec_id"]
    assert len(by_id) > 150


def test_colliding_questions_in_one_batch(spark, sf_small):
    from staylens.plans.catalog import bk
    from staylens.plans.fixtures import PAIRS
    b = bk(spark, sf_small).cache()
    batch, _ = _answers(spark, b, PAIRS[:4])
    assert [batch[k] for k in (1, 2, 3, 4)] == [_answers(spark, b, [t])[0][1] for t in PAIRS[:4]]
    b.unpersist()


def test_months_are_twelve(spark, sf_small):
    import json

    from staylens.plans.catalog import bk
    qs = spark.createDataFrame([(1, "bookings by month and season in July 1997")], "qid int, text string")
    out = json.loads(R.result_json(Q.analyse(bk(spark, sf_small), qs)["metrics"]).first()["result"])
    assert len(out["bookings_by_month"]) == 12 and len(out["revenue_by_month"]) == 12
    assert out["bookings_by_month"]["January"] is None and out["bookings_by_month"]["July"] > 0
