"""What the question path reads and makes of its bookings."""

from pyspark.sql import functions as F

from staylens.operators import clean as C
from staylens.operators import questions as Q


def test_impute_leaves_out_columns_that_are_never_null(spark):
    df = C.normalise_strings(spark.createDataFrame([("a", 1), (None, 2), ("nan", None)], "country string, adr int"))
    assert not df.schema["country"].nullable and C.may_be_null(df) == ["adr"]
    assert sorted(r["country"] for r in df.collect()) == ["Unknown", "Unknown", "a"]


def test_impute_mean_from_31_values_on_without_a_sketch(spark):
    for many in (30, 31, 40):
        df = spark.createDataFrame([(float(k), k) for k in range(many)] + [(0.0, 0), (-0.0, 1), (None, None)], "x double, n int")
        out = C.impute(df)
        assert "approx_count_distinct" not in out._jdf.queryExecution().analyzed().toString()
        mean = sum(range(many)) / (many + 2)
        assert abs(out.agg(F.sum("x")).first()[0] - sum(range(many)) - (mean if many > 30 else 0)) < 1e-9


def test_bookings_of_the_same_scopes_are_one_class(spark):
    rows = [(y, m, c, h) for y in range(1990, 2000) for m in ("May", "July") for c in ("A", "B", None) for h in ("X", "Y")]
    bk = spark.createDataFrame(rows, "arrival_date_year int, arrival_date_month string, country string, hotel string")
    scopes = spark.createDataFrame([("all", False, None, False, None), ("x", False, None, True, "X"), ("97", True, "1997", True, "X")],
                                   "spec_id string, scope_year_set boolean, scope_year string, scope_hotel_set boolean, scope_hotel string")
    scopes = scopes.selectExpr("*", "false scope_month_set", "'' scope_month", "false scope_country_set", "'' scope_country")
    st = Q.scope_table(scopes)
    members, gids = Q.scope_classes(bk, st)
    assert members.count() == len(rows) and members.select("_class").distinct().count() == 3  # not one per year, month, country and hotel
    tagged = Q._with_class(bk, members).join(gids, "_class").groupBy("gid").count()
    want = Q.scoped(bk, st).groupBy("gid").count()
    assert sorted(tagged.collect()) == sorted(want.collect())
