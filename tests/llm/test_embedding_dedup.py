import numpy as np
import pyarrow.parquet as pq

from staylens.llm import embedding_dedup as E


def plain(ids, vectors):
    """Brute force: (links, smallest id reachable) of each row."""
    n = len(ids)
    near = np.zeros((n, n), bool)
    fine = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    for i in range(n):
        for j in range(i + 1, n):
            if fine[i] and fine[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                near[i, j] = near[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
        if new == root:
            break
        root = new
    name = {r: min((ids[i] for i in range(n) if root[i] == r and ids[i] is not None), default=None) for r in set(root)}
    return [(ids[i], int(near[i].sum()), name[root[i]]) for i in range(n)]


def rows_of(df, **more):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(df, **more).collect()), key=str)


def test_edge_rows_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.standard_normal(8).astype(np.float32).tolist() for _ in range(30)]
    vectors += [(np.array(vectors[k % 3]) + 0.08 * rng.standard_normal(8)).astype(np.float32).tolist() for k in range(25)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[1]], None, [], [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0], [1.0, 2.0001]]
    ids = [*range(len(vectors) - 3), None, 5, 5]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>").repartition(4)
    want = sorted(plain(ids, vectors), key=str)
    assert rows_of(df) == want
    assert rows_of(df, block=3) == want  # cells split into pairs of blocks
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in E.near_duplicates(df).collect())


def test_recall_on_planted_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1500, 32))
    x = np.concatenate([base, base[:600] + 0.25 * rng.standard_normal((600, 32)), base[:200] + 0.3 * rng.standard_normal((200, 32))]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = ((unit @ unit.T) >= 0.9).sum(1) - 1
    found = {r.vec_id: r.n_links for r in E.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    links = np.array([found[k] for k in range(len(x))])
    assert want.sum() > 800 and (links <= want).all() and links.sum() >= 0.9 * want.sum()


def test_given_table(spark, sf_small):
    from staylens.llm.queries import QUERIES

    t = pq.read_table(f"{sf_small}/embeddings.parquet")
    out = QUERIES["op2_embedding_dedup"](spark, sf_small)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == t.num_rows


def test_empty(spark):
    assert rows_of(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []


def test_extreme_magnitudes_and_clashing_columns(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [1e-300, -1e-300]), (5, [1.0, -1.0]), (6, [5e-324, 0.0])]
    df = spark.createDataFrame([(i, v, 7, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int, _e string, cid int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(df).collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6)]
