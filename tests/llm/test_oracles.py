"""Every query with SQL equals it on the given tables."""

import duckdb
import pytest

from staylens.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf_small)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
