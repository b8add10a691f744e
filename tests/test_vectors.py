"""Exact vector top-k against NumPy brute force; encoders; incremental refresh."""

import numpy as np
from pyspark.sql import functions as F

from staylens.operators import vectors as V


def test_topk_matches_numpy(spark, sf_small):
    emb = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    pdf = emb.toPandas()
    mat = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    ids = pdf.vec_id.to_numpy()
    q = mat[:3].mean(axis=0)
    got = V.topk_one(emb.select(F.col("vec_id").alias("id"), "embedding"),
                     F.array(*[F.lit(float(x)) for x in q]), 7).collect()
    sims = mat @ q / (np.linalg.norm(mat, axis=1) * np.linalg.norm(q))
    order = sorted(range(len(ids)), key=lambda i: (-round(sims[i], 9), ids[i]))[:7]
    assert [r["id"] for r in got] == [int(ids[i]) for i in order]
    assert np.allclose([r["score"] for r in got], [sims[i] for i in order])


def test_batch_equals_single(spark, sf_small):
    emb = spark.read.parquet(f"{sf_small}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    cents = V.centroids(emb, "embedding", ["label"]).select(F.col("label").alias("qid"), F.col("centroid").alias("query"))
    batch = V.topk_batch(emb, cents, 4)
    one = cents.where("qid = 2").first()["query"]
    single = [r["id"] for r in V.topk_one(emb, F.array(*[F.lit(float(x)) for x in one]), 4).collect()]
    assert [r["id"] for r in batch.where("qid = 2").orderBy("rank").collect()] == single


def test_zero_vector_scores_zero(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<double>")
    got = dict(V.topk_one(df, F.array(F.lit(1.0), F.lit(0.0)), 2).select("id", "score").collect())
    assert got == {2: 1.0, 1: 0.0}


def test_hashing_encoder_and_refresh(spark):
    rows = spark.createDataFrame([(1, "city hotel july"), (2, "resort hotel august"), (3, "city")], "id long, text string")
    enc = lambda df: V.hashing_encoder(df, "text")
    index = enc(rows).select("id", "embedding")
    norms = [float(np.linalg.norm(r["embedding"])) for r in index.collect()]
    assert np.allclose(norms, 1.0)
    changed = spark.createDataFrame([(2, "city hotel july")], "id long, text string")
    deleted = spark.createDataFrame([(3,)], "id long")
    new = {r["id"]: r["embedding"] for r in V.refresh_index(index, changed, deleted, enc).collect()}
    assert set(new) == {1, 2} and np.allclose(new[1], new[2])


def test_pandas_encoder(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    out = V.pandas_encoder(rows, "text", lambda texts: [[len(t), 0.0] for t in texts], 2)
    assert [list(r["embedding"]) for r in out.orderBy("id").collect()] == [[1.0, 0.0], [1.0, 0.0]]


def test_token_hash_encoder_counts_and_is_read_once(spark):
    import hashlib

    from staylens.operators import vectors as V

    rows = [(1, "Ab ab, c9! ab"), (2, ""), (3, None), (4, "é-É x")]
    index = V.token_hash_encoder(spark.createDataFrame(rows, "id long, text string"), "text", dims=8)
    want = {1: ["ab", "ab", "c9", "ab"], 2: [], 4: ["é", "é", "x"]}
    for r in index.collect():
        if r["id"] == 3:
            assert r["embedding"] == [None] * 8
            continue
        places = [int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 8 for t in want[r["id"]]]
        assert r["embedding"] == [float(places.count(d)) for d in range(8)]
    near = V.topk_batch(index.select("id", "embedding"), spark.createDataFrame([(7, [1.0] * 8)], "qid int, query array<double>"), 2)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # the text is not encoded once for each use of its vector


def test_ascii_and_other_texts_are_counted_alike(spark, monkeypatch):
    import hashlib

    from staylens.operators import vectors as V

    texts = ["a b  A1-b", "", None, "café aéb", "x", "y z.", "--", "你好 7", "end"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64
    for r in V.token_hash_encoder(df, "t").select("t", "embedding", V.tokens("t").alias("words")).collect():
        if r["t"] is not None:
            want = [0.0] * 64
            for w in r["words"]:
                want[place(w)] += 1
            assert r["embedding"] == want
    rows, found = V._ascii_tokens(__import__("pyarrow").array(["Ab", "c d", None, "", "e"]).slice(1))  # texts side by side stay apart
    assert rows.tolist() == [0, 0, 3] and found.to_pylist() == ["c", "d", "e"]
