"""Change feed as a stream, applied per micro-batch, replay-safe."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from staylens.session import shared_path
from staylens.sources import change_store as S
from staylens.streaming.change_stream import apply_batch, latest_snapshot, start_change_stream, update_log
from tests.test_changes import SCHEMA, _base


def test_stream_applies_and_skips_replay(spark, tmp_path):
    base_path = shared_path(spark, f"t1-base-{uuid.uuid4().hex}")
    _base(spark).write.parquet(base_path)
    changes_dir = str(tmp_path / "changes")
    ch = spark.createDataFrame([(1, "update", 1, ["adr"], 1.0, None, None, None, None),
                                (2, "delete", 2, None, None, None, None, None, None)], SCHEMA)
    ch.write.parquet(changes_dir)
    q, root = start_change_stream(spark, changes_dir, ch.schema, base_path, now="2024-02-01 00:00:00")
    q.awaitTermination(120)
    snap = {r["id"]: r["adr"] for r in latest_snapshot(spark, root, base_path).collect()}
    assert snap == {1: 1.0, 3: 103.0}
    # replaying batch 0 is a no-op
    apply_batch(spark, root, base_path, ch, 0)
    assert {r["id"] for r in latest_snapshot(spark, root, base_path).collect()} == {1, 3}
    assert update_log(spark, root).count() == 2


BATCHES = [(1, "delete", 2, None, None, None, None, None, None), (2, "update", 1, ["adr"], 9.0, None, None, None, None),
           (3, "delete", 3, None, None, None, None, None, None), (4, "add", None, None, 8.0, 0, "PRT", 1, 1)]


@pytest.mark.parametrize("compact_after", [1, 2, 99])
def test_failing_read_and_crash_lose_nothing(spark, monkeypatch, compact_after):
    base_path, root = (shared_path(spark, f"t1-{n}-{uuid.uuid4().hex}") for n in ("base", "root"))
    _base(spark).write.parquet(base_path)
    batches = [spark.createDataFrame([c], SCHEMA) for c in BATCHES]
    run = lambda k: apply_batch(spark, root, base_path, batches[k], k, compact_after=compact_after)
    run(0)
    with monkeypatch.context() as m:  # a read error is an error, not "nothing applied yet"
        m.setattr(S, "_names", lambda *a, **b: (_ for _ in ()).throw(OSError("read")))
        with pytest.raises(OSError):
            run(1)
    with monkeypatch.context() as m:  # a run that dies between its files and its commit
        m.setattr(S, "_commit", lambda *a, **b: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            run(1)
    assert {r["id"]: r["adr"] for r in latest_snapshot(spark, root, base_path).collect()}.keys() == {1, 3}
    assert update_log(spark, root).count() == 1  # its log rows are there, and not seen
    run(1)
    run(1)  # a replay
    run(2)
    run(3)
    assert {r["id"]: r["adr"] for r in latest_snapshot(spark, root, base_path).collect()} == {1: 9.0, 4: 8.0}  # 3 is never used again
    assert sorted(r["id"] for r in update_log(spark, root).collect()) == [1, 2, 3, 4]


def _folders(spark, path):
    return {n for n in S._names(spark, path) if n.startswith("_bucket=")}


def test_a_batch_writes_only_what_it_touches(spark):
    root = shared_path(spark, f"t1-{uuid.uuid4().hex}")
    rows = spark.range(1000).select("id", (F.col("id") * 2).alias("v"))
    S.create(spark, root, rows, buckets=8)
    up = spark.createDataFrame([(5, -1), (2000, 7)], "id long, v long")
    st = S.merge(spark, root, 0, up, spark.createDataFrame([(6,)], "id long"), compact_after=99)
    touched = {r[0] for r in spark.createDataFrame([(5,), (2000,), (6,)], "id long").select(S.bucket_of("id", 8)).collect()}
    assert _folders(spark, f"{root}/delta/_batch=0") == {f"_bucket={b}" for b in touched}
    want = {k: 2 * k for k in range(1000) if k != 6} | {5: -1, 2000: 7}
    assert {r["id"]: r["v"] for r in S.read(spark, root).collect()} == want
    assert {r["id"]: r["v"] for r in S.lookup(spark, root, spark.createDataFrame([(5,), (6,), (7,), (7,), (9999,)], "id long")).collect()} == {5: -1, 7: 14}
    before = st.files
    st = S.compact(spark, root)
    assert st.deltas == () and {b for b in before if before[b] != st.files[b]} == touched  # the other buckets keep their files
    assert {r["id"]: r["v"] for r in S.read(spark, root).collect()} == want
    st = S.merge(spark, root, 1, up.where("false"), spark.createDataFrame([(2000,), (5,)], "id long"))
    st = S.merge(spark, root, 2, spark.createDataFrame([(5, 50)], "id long, v long"))
    assert {r["id"]: r["v"] for r in S.read(spark, root).collect()} == {**{k: v for k, v in want.items() if k != 2000}, 5: 50}


def test_old_commits_and_files_go(spark):
    root = shared_path(spark, f"t1-{uuid.uuid4().hex}")
    S.create(spark, root, spark.range(50).select("id", F.lit(0).alias("v")), buckets=4)
    for k in range(8):
        S.merge(spark, root, k, spark.createDataFrame([(k, k)], "id long, v int"), compact_after=2)
    assert len(S._commits(spark, root)) == S.KEEP
    assert len(S._names(spark, f"{root}/delta")) <= S.KEEP + 2
    assert {r["id"]: r["v"] for r in S.read(spark, root).collect()} == {k: k if k < 8 else 0 for k in range(50)}


def test_empty_table_and_empty_batch(spark):
    root = shared_path(spark, f"t1-{uuid.uuid4().hex}")
    empty = spark.createDataFrame([], "id long, v int")
    S.create(spark, root, empty)
    S.merge(spark, root, 0, empty, compact_after=1)
    assert S.read(spark, root).collect() == [] and S.state(spark, root).batch == 0


def test_no_table_of_ids_goes_to_the_driver(spark, monkeypatch):
    base, kind, plans = _base(spark), type(spark.range(0)), []
    write = kind.write.fget
    show = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    base_path, root = (shared_path(spark, f"t1-{n}-{uuid.uuid4().hex}") for n in ("base", "root"))
    base.write.parquet(base_path)
    with monkeypatch.context() as m:
        m.setattr(kind, "write", property(lambda df: show(df) or write(df)))
        for k, c in enumerate(BATCHES):
            apply_batch(spark, root, base_path, spark.createDataFrame([c], SCHEMA), k, compact_after=2)
        show(latest_snapshot(spark, root, base_path))
        show(update_log(spark, root))
    sent = re.findall(r"BroadcastHashJoin .*", "\n".join(plans))
    assert sum("SortMergeJoin" in p for p in plans) > 8
    assert sent and all(re.search(r"\[_p#\d+\], \[_p#\d+\], Inner, BuildRight", x) for x in sent)  # the offsets: one row per partition
