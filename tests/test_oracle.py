"""Every registered query with an oracle equals DuckDB on sf0.001 (rows, columns, values)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from staylens.sources.tables import TABLES

FAST = ["null_counts", "impute", "describe_text", "filter_cmp", "cancellation_by_country", "price_stats",
        "bookings_by_month", "meal_by_country", "waitlist_distribution", "eda_answers", "histogram_lead",
        "fused_distributions", "question_spec", "question_filter", "vector_topk_batch", "text_topk",
        "apply_changes", "update_log", "latency_p90", "time_histogram", "template_answer",
        "conversation_scope", "structured_analytics", "question_candidates", "change_table", "change_table_log", "case_filter", "csv_scan", "import_scan",
        "payload_array", "vector_cells_topk", "index_refresh", "candidate_metrics", "db_stats_log", "hotels_with_null",
        "context_text", "answer_json"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, sf_small, name):
    df = E.queries()[name](spark, sf_small)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, df.collect()) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.count() >= 0 and out.columns == ["hotel", "bookings", "canceled", "revenue", "avg_adr"]


def test_every_query_is_registered_with_docstring():
    qs = E.queries()
    assert len(qs) >= 85
    from staylens.plans.catalog import REGISTRY
    assert all(q.doc for q in REGISTRY.values())
