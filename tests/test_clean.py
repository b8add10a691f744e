"""Cleaning and derivation: bin edges, fills, imputation, CSV NULL tokens."""

import pytest
from pyspark.sql import functions as F

from staylens.operators import clean as C
from staylens.sources.csv import read_bookings_csv


def _raw(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_waitlist_bins_edges(spark):
    df = _raw(spark, [(d,) for d in [-1, 0, 1, 7, 8, 30, 31, None]], "days_in_waiting_list int")
    from staylens.functions.exprs import right_closed_bins
    from staylens.sources.schema import WAITLIST_EDGES, WAITLIST_LABELS
    out = df.select("days_in_waiting_list", right_closed_bins("days_in_waiting_list", WAITLIST_EDGES, WAITLIST_LABELS).alias("c"))
    got = {r[0]: r[1] for r in out.collect()}
    assert got == {-1: None, 0: "No wait", 1: "1-7 days", 7: "1-7 days", 8: "8-30 days", 30: "8-30 days",
                   31: "Over 30 days", None: None}


def test_lead_bins_edges(spark):
    from staylens.functions.exprs import right_closed_bins
    from staylens.sources.schema import LEAD_EDGES, LEAD_LABELS
    vals = [0, 1, 7, 8, 30, 31, 90, 91, 180, 181, 365, 366]
    df = _raw(spark, [(v,) for v in vals], "lead_time int")
    got = dict(df.select("lead_time", right_closed_bins("lead_time", LEAD_EDGES, LEAD_LABELS)).collect())
    assert got[0] is None
    assert got[1] == got[7] == "Last minute"
    assert got[8] == got[30] == "1 week to 1 month"
    assert got[31] == got[90] == "1-3 months"
    assert got[91] == got[180] == "3-6 months"
    assert got[181] == got[365] == "6-12 months"
    assert got[366] == "Over 12 months"


def test_normalise_strings(spark):
    df = _raw(spark, [("x",), (None,), ("nan",), ("None",), ("NULL",)], "country string")
    got = [r[0] for r in C.normalise_strings(df).collect()]
    assert got == ["x", "Unknown", "Unknown", "Unknown", "NULL"]


def test_impute_mode_tie_smallest_and_all_null(spark):
    rows = [(1, 2, None, "b", None), (2, 1, 5.0, "a", None), (3, 1, None, "b", None), (4, 2, 7.0, "a", None), (5, None, None, None, None)]
    df = _raw(spark, rows, "id long, k int, v double, s string, allnull double")
    out = {r["id"]: r for r in C.impute(df).collect()}
    assert out[5]["k"] == 1  # mode tie 1 vs 2 -> smallest
    assert out[5]["s"] == "a"  # text mode tie -> smallest
    assert out[1]["v"] == 5.0  # 2 distinct (<= 30) -> mode (tie 5 vs 7 -> 5)
    assert out[5]["allnull"] is None


def test_impute_mean_for_many_distinct(spark):
    rows = [(i, float(i)) for i in range(40)] + [(99, None)]
    df = _raw(spark, rows, "id long, v double")
    out = {r["id"]: r["v"] for r in C.impute(df).collect()}
    assert out[99] == pytest.approx(sum(range(40)) / 40)


def test_flags_and_totals(spark):
    df = _raw(spark, [(1, 2, 3, 2, 1.0, 0, 100.0, None, 0, 2, 1, 5, 0)],
              "stays_in_weekend_nights int, stays_in_week_nights int, adults int, x int, children double, babies int, "
              "adr double, previous_bookings_not_canceled int, previous_cancellations int, booking_changes int, "
              "required_car_parking_spaces int, total_of_special_requests int, days_in_waiting_list int")
    df = df.withColumn("lead_time", F.lit(0))
    r = C.derive(df).first()
    assert r["total_nights"] == 3 and r["total_guests"] == 4.0 and r["revenue"] == 300.0
    assert r["has_previous_stay"] == 0 and r["has_booking_changes"] == 1 and r["has_special_requests"] == 1
    assert r["waitlist_category"] == "No wait" and r["lead_time_category"] is None


def test_csv_null_tokens(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("hotel,children,country,adr,lead_time\nCity Hotel,NA,NULL,1.5,3\nResort Hotel,,nan,x,4.0\n")
    rows = read_bookings_csv(spark, str(p)).select("hotel", "children", "country", "adr", "lead_time").collect()
    assert rows[0]["children"] is None and rows[0]["country"] is None and rows[0]["adr"] == 1.5
    assert rows[1]["children"] is None and rows[1]["country"] is None and rows[1]["adr"] is None
    assert rows[1]["lead_time"] == 4


def test_date_parse_bad_is_null(spark):
    df = _raw(spark, [("2020-01-02",), ("x",)], "reservation_status_date string")
    got = [r[0] for r in C.parse_dates(df).collect()]
    assert str(got[0]) == "2020-01-02" and got[1] is None


def test_sample_exact_and_repeatable(spark, sf_small):
    from staylens.plans.catalog import bk
    b = bk(spark, sf_small)
    a = [r.id for r in C.sample_n(b, 100, 42).collect()]
    c = [r.id for r in C.sample_n(b, 100, 42).collect()]
    assert len(a) == 100 and a == c
    assert C.sample_n(b, 10**6, 42).count() == b.count()


def test_json_payload_and_initial_import(spark, tmp_path):
    import json
    from staylens.sources import sinks
    from staylens.sources.csv import read_bookings_json, read_payload
    p = tmp_path / "batch.json"
    p.write_text(json.dumps([{"hotel": "City Hotel", "adr": 90.5, "stays_in_week_nights": 2, "unknown": 1},
                             {"hotel": "Resort Hotel", "country": "PRT"}, {"hotel": "City Hotel", "adr": 1}]))
    raw = read_bookings_json(spark, "file://" + str(p), "array")  # the layout is told, not guessed from the path
    assert raw.count() == 2 and raw.where("adr = 90.5").count() == 0 and "unknown" not in raw.columns
    valid, invalid = read_payload(spark, str(p), "array")
    assert valid.count() == 2 and [r["unknown"] for r in invalid.collect()] == [["unknown"]]
    raw = raw.withColumn("id", F.monotonically_increasing_id())
    out = sinks.initial_import(raw, str(tmp_path / "snap"), str(tmp_path / "log"), "batch.json",
                               now="2024-01-01 00:00:00")
    assert out.count() == 2
    log = spark.read.parquet(str(tmp_path / "log")).first()
    assert log["operation"] == "initial_import" and log["record_count"] == 2


def test_payload_lines_split_invalid(spark, tmp_path):
    from staylens.sources.csv import read_payload
    p = tmp_path / "b.jsonl"
    p.write_text('{"hotel": "City Hotel", "adr": 10.5}\n{"hotel": "x", "bogus": 1}\nnot json\n{"country": "PRT"}\n')
    valid, invalid = read_payload(spark, str(p))
    assert valid.count() == 2 and invalid.count() == 2
    assert sorted(r["hotel"] or "-" for r in valid.collect()) == ["-", "City Hotel"]


def test_clean_staged_equals_clean(spark, sf_small, tmp_path):
    from staylens.sources.tables import bookings
    raw = bookings(spark, sf_small)
    a = C.clean(raw, now="2024-01-01 00:00:00")
    b = C.clean_staged(raw, str(tmp_path / "stage"), now="2024-01-01 00:00:00")
    cols = a.columns
    plain = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.select(cols).collect())
    assert plain(a) == plain(b)  # means are summed in any order


def test_impute_counts_values_of_columns_with_nulls_only(spark):
    df = spark.createDataFrame([(1, "a", 1, 5), (2, None, 1, 6), (3, "b", None, 6), (4, "b", 2, 7)], "id long, t string, x int, whole int")
    out = C.impute(df)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 1, 5), (2, "b", 1, 6), (3, "b", 1, 6), (4, "b", 2, 7)]
    assert "count_if" in out._jdf.queryExecution().optimizedPlan().toString() or "isnull(whole" in out._jdf.queryExecution().analyzed().toString()
