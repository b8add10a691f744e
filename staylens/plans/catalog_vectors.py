"""Registered vector / text retrieval queries (V1-V7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import changes as A
from ..operators import clean as C
from ..operators import text_index as X
from ..operators import vector_cells as W
from ..operators import vectors as V
from ..session import shared_path
from ..sources import change_store as S
from ..sources.tables import read_table
from .catalog import REGISTRY, bk, describe_sql, register, rounded
from .catalog_changes import _UPD_COLS, CHANGE_STAMP, _feed_sql, change_feed
from .fixtures import questions_df, questions_values_sql
from .oracle_questions import encoded_ctes
from .sqltext import clean_ctes

_UNNEST = ("u AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, "
           "generate_subscripts(embedding, 1) AS i FROM embeddings)")


@register("vector_topk", f"""WITH {_UNNEST},
c AS (SELECT i, avg(x) AS cx FROM u GROUP BY i),
cn AS (SELECT sqrt(sum(cx * cx)) AS n FROM c),
d AS (SELECT u.vec_id, sum(u.x * c.cx) AS dp, sqrt(sum(u.x * u.x)) AS vn FROM u JOIN c USING (i) GROUP BY u.vec_id),
s AS (SELECT vec_id, CASE WHEN vn * (SELECT n FROM cn) = 0 THEN 0.0 ELSE dp / (vn * (SELECT n FROM cn)) END AS score FROM d)
SELECT vec_id, ROUND(score, 6) AS score FROM s ORDER BY ROUND(score, 9) DESC, vec_id LIMIT 10""")
def q_vector_topk(spark, sf_dir):
    """V2 + V3: exact cosine top-10 of all embeddings against their centroid (query derived by Spark)."""
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    centroid = V.centroids(emb).select("centroid").scalar()
    return rounded(V.topk_one(emb, centroid, 10).select(F.col("id").alias("vec_id"), "score"))


@register("vector_topk_batch", f"""WITH {_UNNEST},
c AS (SELECT label, i, avg(x) AS cx FROM u GROUP BY label, i),
cn AS (SELECT label, sqrt(sum(cx * cx)) AS n FROM c GROUP BY label),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS vn FROM u GROUP BY vec_id),
d AS (SELECT c.label AS qid, u.vec_id, sum(u.x * c.cx) AS dp FROM u JOIN c USING (i) GROUP BY c.label, u.vec_id),
s AS (SELECT d.qid, d.vec_id, CASE WHEN vn.vn * cn.n = 0 THEN 0.0 ELSE d.dp / (vn.vn * cn.n) END AS score
      FROM d JOIN vn USING (vec_id) JOIN cn ON cn.label = d.qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ROUND(score, 9) DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, ROUND(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def q_vector_topk_batch(spark, sf_dir):
    """V4: exact cosine top-5 for a table of queries (one centroid per label, derived by Spark)."""
    emb = read_table(spark, sf_dir, "embeddings")
    queries = V.centroids(emb, "embedding", ["label"]).select(F.col("label").alias("qid"), F.col("centroid").alias("query"))
    out = V.topk_batch(emb.select(F.col("vec_id").alias("id"), "embedding"), queries, 5)
    return rounded(out.select("qid", F.col("id").alias("vec_id"), "score", F.col("rank").cast("int").alias("rank")))


@register("vector_cells_topk", REGISTRY["vector_topk_batch"].oracle)
def q_vector_cells_topk(spark, sf_dir):
    """V3 + V4: the same top-5 from a stored cell index, reading only cells whose bound reaches the fifth score."""
    emb = read_table(spark, sf_dir, "embeddings")
    queries = V.centroids(emb, "embedding", ["label"]).select(F.col("label").alias("qid"), F.col("centroid").alias("query"))
    ix = W.build_index(emb.select(F.col("vec_id").alias("id"), "embedding"))
    out = W.topk(spark, ix, queries, 5)[0]
    return rounded(out.select("qid", F.col("id").alias("vec_id"), "score", F.col("rank").cast("int").alias("rank")))


_REFRESH_SQL = clean_ctes() + ", " + _feed_sql(("update", "delete")) + """, snap2 AS (SELECT b.* REPLACE (
""" + ",\n".join(f"    CASE WHEN f.{c}_s THEN f.{c}_v ELSE b.{c} END AS {c}" for c in _UPD_COLS) + """)
  FROM bk b LEFT JOIN fold f USING (id) WHERE NOT COALESCE(f.deleted, false)), texts AS (""" + describe_sql("text").replace("FROM bk", "FROM snap2") + "),\n" + encoded_ctes("texts", "dv", "id") + """
SELECT id, CAST(sum(c) AS BIGINT) AS n_tokens, CAST(sum(c * place) AS BIGINT) AS place_sum FROM dv GROUP BY id"""


@register("index_refresh", _REFRESH_SQL)
def q_index_refresh(spark, sf_dir):
    """V7: a stored vector index of all bookings after a feed of updates and deletes; only changed rows are encoded and only their buckets read."""
    base, root = (shared_path(spark, f"index-{n}-{uuid.uuid4().hex}") for n in ("base", "vectors"))
    bk(spark, sf_dir).write.parquet(base)
    rows = spark.read.parquet(base)
    encode = lambda df: V.token_hash_encoder(C.describe(df), "description").select("id", "embedding")
    S.create(spark, root, encode(rows))
    res = A.apply_changes(rows, change_feed(spark, sf_dir, ("update", "delete")), now=CHANGE_STAMP)
    done = res["status"].where("applied")
    changed = res["snapshot"].join(done.where(F.col("op") == A.UPDATE).select("id").distinct(), "id", "left_semi")
    S.merge(spark, root, 0, encode(changed), done.where(F.col("op") == A.DELETE).select("id").distinct())
    places = F.zip_with("embedding", F.sequence(F.lit(0), F.size("embedding") - 1), lambda c, i: c * i)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x).cast("long")
    return S.read(spark, root).select("id", total("embedding").alias("n_tokens"), total(places).alias("place_sum"))


_TOK = "'[\\p{L}\\p{N}]+'"


@register("text_topk", f"""WITH dt AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), {_TOK})) AS term FROM documents) GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln(((SELECT n FROM nd) + 1) / (count(*) + 1)) AS idf FROM dt GROUP BY term),
w AS (SELECT doc_id, term, tf * idf AS w FROM dt JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM w GROUP BY doc_id),
qt AS (SELECT qid, term, count(*) AS qtf FROM (
  SELECT qid, unnest(regexp_extract_all(lower(text), {_TOK})) AS term FROM {questions_values_sql()}) GROUP BY qid, term),
qw AS (SELECT qid, term, qtf * COALESCE(idf, ln((SELECT n FROM nd) + 1)) AS qw FROM qt LEFT JOIN idf USING (term)),
qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY qid),
dp AS (SELECT qw.qid, w.doc_id, sum(w.w * qw.qw) AS dp FROM w JOIN qw USING (term) GROUP BY qw.qid, w.doc_id),
s AS (SELECT dp.qid, dp.doc_id, CASE WHEN dn.dn * qn.qn = 0 THEN 0.0 ELSE dp.dp / (dn.dn * qn.qn) END AS score
      FROM dp JOIN dn USING (doc_id) JOIN qn USING (qid)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ROUND(score, 9) DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, ROUND(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def q_text_topk(spark, sf_dir):
    """V1 (corpus TF-IDF) + V4: top-5 whole documents for each fixed question, from a stored inverted index with block maxima."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = X.search(spark, X.build_index(docs), questions_df(spark), 5)
    return rounded(out.select("qid", "doc_id", "score", F.col("rank").cast("int").alias("rank")))
