"""Change application: accumulation, missing ids, deletes, id high-water mark."""

from staylens.operators import changes as A

SCHEMA = ("seq long, op string, id long, changed_columns array<string>, adr double, "
          "days_in_waiting_list int, country string, stays_in_weekend_nights int, stays_in_week_nights int")


def _base(spark):
    from staylens.operators import clean as C
    rows = [(i, 100.0 + i, 0, "PRT", 1, 2) for i in (1, 2, 3)]
    raw = spark.createDataFrame(rows, "id long, adr double, days_in_waiting_list int, country string, "
                                      "stays_in_weekend_nights int, stays_in_week_nights int")
    from pyspark.sql import functions as F
    from staylens.sources.schema import RAW_FIELDS
    for name, t in RAW_FIELDS:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(t))
    return C.derive(raw).withColumn("last_updated", F.lit("2024-01-01").cast("timestamp"))


def test_apply_changes_semantics(spark):
    base = _base(spark)
    ch = spark.createDataFrame([
        (1, "update", 1, ["adr"], 150.0, None, None, None, None),
        (2, "update", 1, ["days_in_waiting_list"], None, 9, None, None, None),  # accumulates with seq 1
        (3, "update", 1, ["adr"], 175.0, None, None, None, None),               # latest adr wins
        (4, "update", 99, ["adr"], 1.0, None, None, None, None),                # missing id: not applied
        (5, "delete", 3, None, None, None, None, None, None),                   # delete highest id
        (6, "update", 3, ["adr"], 5.0, None, None, None, None),                 # after delete: not applied
        (7, "delete", 3, None, None, None, None, None, None),                   # second delete: not applied
        (8, "add", None, None, 80.0, 0, "GBR", 1, 1),
    ], SCHEMA)
    res = A.apply_changes(base, ch, high_water=3, now="2024-02-01 00:00:00")
    snap = {r["id"]: r for r in res["snapshot"].collect()}
    assert set(snap) == {1, 2, 4}  # 3 deleted; the add gets 4 (high-water 3), never a reused id
    assert snap[1]["adr"] == 175.0 and snap[1]["days_in_waiting_list"] == 9
    assert snap[1]["revenue"] == 175.0 * 3 and snap[1]["waitlist_category"] == "8-30 days"
    assert snap[2]["adr"] == 102.0
    assert snap[4]["country"] == "GBR" and snap[4]["total_nights"] == 2 and snap[4]["revenue"] == 160.0
    status = {r["seq"]: r["applied"] for r in res["status"].collect()}
    assert status == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False, 7: False, 8: True}
    audit = {r["id"]: r["details"] for r in res["audit"].collect()}
    assert audit[5] == "Deleted booking ID 3" and audit[8] == "Added booking for GBR" and 4 not in audit


def test_no_changes_is_identity(spark):
    base = _base(spark)
    empty = spark.createDataFrame([], SCHEMA)
    res = A.apply_changes(base, empty, now="2024-02-01 00:00:00")
    assert sorted(map(tuple, res["snapshot"].select("id", "adr").collect())) == sorted(
        map(tuple, base.select("id", "adr").collect()))


def test_assign_ids_dense(spark):
    df = spark.range(0, 1000).selectExpr("id * 7 AS seq")
    ids = sorted(r["id"] for r in A.assign_ids(df, 10).collect())
    assert ids == list(range(11, 1011))
    by_seq = [r["id"] for r in A.assign_ids(df, 10).orderBy("seq").collect()]
    assert by_seq == list(range(11, 1011))


def _feed(spark):
    return spark.createDataFrame([
        (1, "delete", 3, None, None, None, None, None, None),                   # the highest id
        (2, "add", None, None, 80.0, 0, "GBR", 1, None),                        # id 4; a part of its nights is missing
        (3, "update", 4, ["adr"], 99.0, None, None, None, None),                # added earlier in the feed
        (4, "update", 5, ["adr"], 1.0, None, None, None, None),                 # not there yet
        (5, "add", None, None, 70.0, 0, "FRA", 1, 1),                           # id 5
        (6, "delete", 5, None, None, None, None, None, None),
        (7, "update", 1, ["country"], None, None, None, None, None),            # to NULL
        (8, "add", None, None, 60.0, 0, None, None, None),                      # id 6: 5 is not used again
        (9, "update", 6, ["days_in_waiting_list"], None, 3, None, None, None),
    ], SCHEMA)


def _applied(base, feed, cuts):
    """The feed applied in batches that end at ``cuts``: snapshot rows, status, audit texts."""
    water, status, audit, last = None, {}, {}, 0
    for cut in [*cuts, 99]:
        res = A.apply_changes(base, feed.where(f"seq > {last} AND seq <= {cut}"), high_water=water, now="2024-02-01 00:00:00")
        status |= {r["seq"]: r["applied"] for r in res["status"].collect()}
        audit |= {r["id"]: r["details"] for r in res["audit"].collect()}
        water, last = res["high_water"].first()["id"], cut
        base = base.sparkSession.createDataFrame(res["snapshot"].collect(), base.schema)
    return sorted(map(str, base.collect())), status, audit


def test_any_split_gives_the_same_rows(spark):
    base, feed = _base(spark), _feed(spark)
    whole = _applied(base, feed, [])
    assert whole[1] == {1: True, 2: True, 3: True, 4: False, 5: True, 6: True, 7: True, 8: True, 9: True}
    rows = {r["id"]: r for r in A.apply_changes(base, feed)["snapshot"].collect()}
    assert set(rows) == {1, 2, 4, 6} and rows[4]["adr"] == 99.0 and rows[4]["total_nights"] == 1 and rows[4]["total_guests"] == 0
    assert rows[1]["country"] is None and rows[6]["waitlist_category"] == "1-7 days"
    for cuts in ([1], [2], [5], [1, 4, 7]):
        assert _applied(base, feed, cuts) == whole


def test_parity_without_recompute(spark):
    new = A.apply_changes(_base(spark), _feed(spark), recompute=False)["snapshot"].where("id = 4").first()
    assert new["total_nights"] == 1 and new["revenue"] == 80.0 and new["waitlist_category"] is None and new["has_special_requests"] is None
