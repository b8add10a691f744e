"""Metric menu edge cases and properties."""

from pyspark.sql import functions as F

from staylens.functions.quantiles import rank_quantiles
from staylens.operators import metrics as M


def test_rank_quantiles_small_n(spark):
    for n, want90, want95 in [(1, 0, 0), (10, 9, 9), (20, 18, 19)]:
        df = spark.createDataFrame([(float(i),) for i in range(n)], "t double")
        r = rank_quantiles(df, "t", {"p90": 0.9, "p95": 0.95}).first()
        s = sorted(range(n))
        assert r["p90"] == s[int(0.9 * n)] == want90
        assert r["p95"] == s[int(0.95 * n)] == want95


def test_rank_quantiles_matches_python_with_duplicates(spark):
    import random
    random.seed(1)
    vals = [random.randint(0, 30) for _ in range(257)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "t int, g int")
    got = {r["g"]: (r["p90"], r["p95"]) for r in rank_quantiles(df, "t", {"p90": 0.9, "p95": 0.95}, ["g"]).collect()}
    for g in range(3):
        s = sorted(v for i, v in enumerate(vals) if i % 3 == g)
        assert got[g] == (s[int(0.9 * len(s))], s[int(0.95 * len(s))])


def test_zero_denominators_and_null_keys(spark):
    schema = "hotel string, is_canceled int, country string, revenue double, is_repeated_guest int"
    empty = spark.createDataFrame([], schema)
    r = M.cancellation(empty).first()
    assert r["total_bookings"] == 0 and r["cancellation_rate"] == 0.0
    df = spark.createDataFrame([("A", 1, None, 1.0, 0), ("A", 0, "X", 2.0, 0)], schema)
    assert [r["country"] for r in M.cancellation_by_country(df).collect()] == ["X"]


def test_months_absent_are_null(spark):
    df = spark.createDataFrame([("July", 0, 10.0)], "arrival_date_month string, is_canceled int, revenue double")
    rows = {r["arrival_date_month"]: r["bookings"] for r in M.bookings_by_month(df).collect()}
    assert len(rows) == 12 and rows["July"] == 1 and rows["May"] is None


def test_distributions_sum_to_total(spark, sf_small):
    from staylens.plans.catalog import bk
    b = bk(spark, sf_small).cache()
    total = b.count()
    fused = M.fused_distributions(b)
    sums = dict(fused.groupBy("metric").agg(F.sum("n")).collect())
    for metric in ["hotel_distribution", "meal_distribution", "deposit_distribution", "segment_distribution"]:
        assert sums[metric] == total
    # the fused pass equals the single distributions
    single = {r["hotel"]: r["n"] for r in M.hotel_distribution(b).collect()}
    fused_h = {r["key"]: r["n"] for r in fused.where("metric = 'hotel_distribution'").collect()}
    assert single == fused_h
    b.unpersist()


def test_filter_and_complement_cover_all(spark, sf_small):
    from staylens.operators.filters import filter_bookings
    from staylens.plans.catalog import bk
    b = bk(spark, sf_small)
    a = filter_bookings(b, {"hotel": "Resort Hotel"}).count()
    c = filter_bookings(b, {"hotel": {"lt": "Resort Hotel"}}).count() + filter_bookings(b, {"hotel": {"gt": "Resort Hotel"}}).count()
    assert a + c == b.count()


def test_meal_by_country_zero_cells(spark):
    rows = [("P", "BB"), ("P", "BB"), ("Q", "HB")]
    df = spark.createDataFrame(rows, "country string, meal string")
    got = {(r["country"], r["meal"]): r["n"] for r in M.meal_by_country(df).collect()}
    assert got == {("P", "BB"): 2, ("P", "HB"): 0, ("Q", "BB"): 0, ("Q", "HB"): 1}


def test_rank_quantiles_property(spark):
    """Hypothesis: sorted[int(q*n)] per group equals Python on random inputs."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 2), st.integers(-5, 5)), min_size=1, max_size=60))
    def check(rows):
        df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g int, t double")
        got = {r["g"]: (r["n"], r["p90"]) for r in rank_quantiles(df, "t", {"p90": 0.9}, ["g"]).collect()}
        for g in {g for g, _ in rows}:
            s = sorted(float(v) for gg, v in rows if gg == g)
            assert got[g] == (len(s), s[int(0.9 * len(s))])

    check()


def test_unknown_filter_column_modes(spark):
    import pytest
    from staylens.operators.filters import filter_bookings
    df = spark.createDataFrame([(1, "A")], "id long, hotel string")
    with pytest.raises(KeyError):
        filter_bookings(df, {"nope": 1})
    assert filter_bookings(df, {"nope": 1, "hotel": "A"}, on_unknown="ignore").count() == 1
    assert filter_bookings(df, {"nope": 1}, on_unknown="empty").count() == 0


def test_db_stats_with_log(spark):
    df = spark.createDataFrame([(1, "PRT", None)], "is_canceled int, country string, last_updated timestamp")
    log = spark.createDataFrame([(1,), (2,)], "id long")
    r = M.db_stats(df, log).first()
    assert r["total_bookings"] == 1 and r["canceled_bookings"] == 1 and r["total_updates"] == 2


def test_approx_quantile_switch(spark):
    df = spark.range(0, 10001).selectExpr("CAST(id AS DOUBLE) AS adr", "CAST(id % 7 AS INT) AS lead_time",
                                          "CAST(id % 9 AS INT) AS total_nights")
    exact = M.price_stats(df).first()["median_price"]
    approx = M.price_stats(df, approx=True).first()["median_price"]
    assert exact == 5000.0 and abs(approx - exact) <= 1.0
