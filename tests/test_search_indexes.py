"""Stored indexes: vector cells and text blocks against exhaustive search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import text_index as X
from staylens.operators import vector_cells as W
from staylens.operators import vectors as V


def vectors(n=900, dim=6):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, dim)) * 3
    rows = [(k, (centres[k % 12] + rng.standard_normal(dim) * 0.2).tolist()) for k in range(n)]
    rows += [(n + k, rows[5][1]) for k in range(30)]  # copies: ties
    return rows + [(n + 40, [0.0] * dim), (n + 41, [0.0] * dim), (n + 42, None)]


def test_cells_equal_exhaustive_search_and_skip_most(spark):
    rows = vectors()
    index = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(k, v) for k, (_, v) in enumerate(rows[3:40:4])] + [(90, [0.0] * 6), (91, [1.0, -1.0, 2.0, 0.0, 0.0, 5.0]), (92, None)], "qid int, query array<double>")
    ix = W.build_index(index, cells=24)
    assert int(ix.sizes.sum()) == len(rows) - 1 and ix.sizes[-1] == 2
    for k in (1, 7, 40):
        found, shares = W.topk(spark, ix, queries, k)
        got = sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in found.collect())
        want = sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in V.topk_batch(index, queries, k).collect())
        assert got == want
    found, shares = W.topk(spark, ix, queries.where("qid < 90"), 7)
    assert 0 < shares[0] < 0.35  # clustered vectors: most cells are ruled out


def test_cells_several_passes_few_and_no_vectors(spark, monkeypatch):
    rows = vectors(60)
    index = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame([(f"q{k}", rows[k][1]) for k in range(20)], "qid string, query array<double>")
    monkeypatch.setattr(W, "PASS_CELLS", 30)
    ix = W.build_index(index)
    found, shares = W.topk(spark, ix, queries, 5)
    assert len(shares) > 2
    assert sorted((r["qid"], r["rank"], r["id"]) for r in found.collect()) == sorted((r["qid"], r["rank"], r["id"]) for r in V.topk_batch(index, queries, 5).collect())
    empty = W.build_index(index.where("false"))
    assert W.topk(spark, empty, queries, 5)[0].collect() == [] and W.topk(spark, ix, queries.where("false"), 5)[0].collect() == []


@pytest.mark.parametrize("range_docs", [4, 10_000])
def test_text_index_equals_exhaustive_search(spark, range_docs):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([1, 5, 30, 200])))) for k in range(150)]
    docs += [(200 + k, docs[4][1]) for k in range(6)] + [(300, None), (301, ""), (302, "!!")]
    queries = [(0, "w3 w50 w50"), (1, "w0"), (2, "w59 unseen"), (3, "unseen"), (4, ""), (5, None), (6, "W7, w8; w9!")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "qid int, text string")
    path = X.build_index(d, range_docs=range_docs)
    for k in (1, 5):
        got = sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in X.search(spark, path, q, k).collect())
        want = sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in V.tfidf_topk(d, q, k).collect())
        assert got == want
    left = {r["qid"]: (r["ranges"], r["scored"]) for r in X.ranges_left(spark, path, q, 1).collect()}
    assert all(0 < scored <= n for n, scored in left.values())
    if range_docs == 4:
        assert left[1][1] < left[1][0]  # ranges of long documents cannot reach the best score


def test_text_index_of_nothing(spark):
    path = X.build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert X.search(spark, path, spark.createDataFrame([(1, "a b")], "qid int, text string"), 3).collect() == []


def test_a_documents_terms_are_counted_in_its_row(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array([["b", "a", "b"], [], ["a"]])], ["doc", "tokens"])
    (out,) = X._count_terms([batch])
    got = {r["doc"]: dict(zip(r["terms"], r["tf"], strict=True)) for r in out.to_pylist()}
    assert got == {5: {"a": 1, "b": 2}, 6: {}, 7: {"a": 1}}
    monkeypatch.setattr(X, "COMMON_TERMS", 2)  # other terms' idf is joined
    docs = spark.createDataFrame([(k, f"a b{k % 3} c{k}") for k in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b1 c4"), (2, "a c7")], "qid int, text string")
    key = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert key(X.search(spark, X.build_index(docs), asked, 4)) == key(V.tfidf_topk(docs, asked, 4))
