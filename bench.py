"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Flow (like the service): ingest once (clean -> partitioned Parquet snapshot),
then answer queries from the stored snapshot and the driver's tables. Every
timed step runs to completion (``collect`` of a small result, or a ``noop``
write of a full one).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import functions as F

    from staylens.operators import changes as A
    from staylens.operators import clean as C
    from staylens.operators import metrics as M
    from staylens.operators import questions as Q
    from staylens.operators import report as R
    from staylens.operators import vectors as V
    from staylens.plans.catalog_changes import change_feed
    from staylens.plans.catalog_history import runs
    from staylens.plans.fixtures import questions_df
    from staylens.session import local_session, shared_path
    from staylens.sources import sinks
    from staylens.sources.tables import bookings, read_table

    spark = local_session(cpus, shuffle_partitions=int(cpus), app="staylens-bench")
    scratch = shared_path(spark, "bench-" + next(tempfile._get_candidate_names()))
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    snap_path = f"{scratch}/bookings"
    timed("ingest_clean_write", lambda: sinks.write_snapshot(
        C.clean_staged(bookings(spark, sf_dir), f"{scratch}/staging", now="2024-01-01 00:00:00"), snap_path))
    bk = spark.read.parquet(snap_path)

    timed("metric_scalars_fused", lambda: M.scalars(bk, list(M.scalar_blocks().keys())).collect())
    timed("fused_distributions", lambda: M.fused_distributions(bk).collect())
    timed("filter_month_year", lambda: bk.where((F.col("arrival_date_year") == 1997)
                                                 & (F.col("arrival_date_month") == "July"))
          .groupBy("hotel").agg(F.count(F.lit(1)), F.sum("revenue"), F.avg("adr")).collect())
    timed("cancellation_by_country", lambda: M.cancellation_by_country(bk).collect())
    timed("meal_by_country", lambda: M.meal_by_country(bk).collect())
    timed("eda_answers", lambda: M.eda_answers(bk, 1997).collect())
    timed("histogram_revenue", lambda: __import__("staylens.functions.quantiles", fromlist=["x"])
          .equal_width_histogram(bk, "revenue", 50).collect())

    def questions():
        qs = questions_df(spark)
        res = Q.analyse(bk, qs)
        R.context_text(res["metrics"], qs).collect()
        R.template_answer(res["metrics"], qs).collect()
    timed("question_batch_answers", questions)

    emb = read_table(spark, sf_dir, "embeddings")
    timed("vector_topk_batch", lambda: V.topk_batch(
        emb.select(F.col("vec_id").alias("id"), "embedding"),
        V.centroids(emb, "embedding", ["label"]).select(F.col("label").alias("qid"), F.col("centroid").alias("query")),
        5).collect())
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    timed("text_topk_tfidf", lambda: V.tfidf_topk(docs, questions_df(spark), 5).collect())

    def changes():
        res = A.apply_changes(bk, change_feed(spark, sf_dir), now="2024-02-01 00:00:00")
        noop(res["snapshot"])
        res["audit"].count()
    timed("apply_changes", changes)
    timed("latency_stats", lambda: (R.latency_summary(runs(spark, sf_dir)).collect(),
                                    R.latency_percentiles(runs(spark, sf_dir), ["kind"]).collect()))

    total = round(sum(times.values()), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
