"""Generator (S5) and sinks."""

import json

from pyspark.sql import functions as F

from staylens.sources import generator as G
from staylens.sources import sinks


def test_generator_ranges_and_determinism(spark):
    seeds = spark.range(0, 2000).withColumnRenamed("id", "k")
    a = G.generate_bookings(seeds.repartition(1), "k", seed=7, today="2024-01-01")
    b = G.generate_bookings(seeds.repartition(7), "k", seed=7, today="2024-01-01")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))  # independent of partitioning
    r = a.agg(F.min("lead_time"), F.max("lead_time"), F.min("arrival_date_day_of_month"),
              F.max("arrival_date_day_of_month"), F.min("adr"), F.max("adr"),
              F.count_if((F.col("is_canceled") == 1) != (F.col("reservation_status") == "Canceled")),
              F.count_if(~F.col("hotel").isin(*G.HOTELS)), F.avg("is_canceled")).first()
    assert 1 <= r[0] and r[1] <= 365 and 1 <= r[2] and r[3] <= 28
    assert r[4] >= 40.0 and r[5] <= 200.0 and r[6] == 0 and r[7] == 0
    assert 0.2 < r[8] < 0.4  # cancellation probability 0.3
    assert a.where("total_nights <> stays_in_weekend_nights + stays_in_week_nights").count() == 0


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0])], "id long, s string, v array<double>")
    assert json.loads(sinks.to_json_column(df).first()["json"]) == {"id": 1, "s": "a", "v": [1.0, 2.0]}
    sinks.write_json(df, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back["s"] == "a" and list(back["v"]) == [1.0, 2.0]
    sinks.append_log(df.select("id", "s"), str(tmp_path / "log"))
    sinks.append_log(df.select("id", "s"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_a_failed_write_is_never_seen_and_scans_skip_files(spark, monkeypatch):
    import uuid

    import pytest

    from staylens.session import shared_path
    from staylens.sources import snapshots as N

    root = shared_path(spark, f"snap-{uuid.uuid4().hex}")
    rows = spark.range(1000).select("id", (F.col("id") % 7).cast("int").alias("lead_time"), F.when(F.col("id") % 2 == 0, "A b%+:é").otherwise("B").alias("hotel"),
                                    (2000 + F.col("id") / 100).cast("int").alias("arrival_date_year"), F.lit(None).cast("double").alias("adr"))
    N.publish(rows, root)
    with monkeypatch.context() as m:  # killed between its data files and its manifest
        m.setattr(N, "versions", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            N.publish(rows.where("id < 5"), root)
    assert N.scan(spark, root).count() == 1000 and len(N.versions(spark, root)) == 1
    bounds = {"arrival_date_year": (2003, 2004), "lead_time": (2, None)}
    got = sorted(r["id"] for r in N.scan(spark, root, bounds).collect())
    assert got == sorted(r["id"] for r in rows.where("arrival_date_year BETWEEN 2003 AND 2004 AND lead_time >= 2").collect())
    all_files, some = N.files(spark, N.versions(spark, root)[-1]), N.files(spark, N.versions(spark, root)[-1], bounds)
    assert 0 < some.count() < all_files.count()
    assert N.scan(spark, root, {"id": (5000, None)}).collect() == [] and N.scan(spark, root, {"adr": (0.0, None)}).collect() == []
    N.publish(rows.where("id < 5"), root)
    assert N.scan(spark, root).count() == 5 and N.scan(spark, root, version=0).count() == 1000
