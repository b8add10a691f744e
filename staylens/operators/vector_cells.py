"""V3/V4 over a stored cell index: exact cosine top-k that reads only cells which can still hold a result.

Unit vectors are kept by the nearest of some centres, with each cell's widest angle from its centre. By the triangle
inequality no vector of a cell is nearer to a query than the angle between query and centre less that width, so a cell has
an upper bound on its scores. A first round reads each query's best cells until they hold k vectors; the k-th score then
found rules out every cell with a lower bound, and a second round reads what is left. Two rounds, whatever the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import normalize
from ..session import shared_path, show_code
from .vectors import PASS_BYTES, PASS_CELLS, RANK_DIGITS

#: Cells of an index at most, vectors in the sample per cell, and rounds in which the centres are fitted to it.
CELLS, SAMPLE_PER_CELL, ROUNDS = 256, 64, 6
#: A bound this much below the k-th score still counts: rounding of scores and of angles.
SLACK = 1e-7


@dataclass(frozen=True)
class CellIndex:
    """A stored index: its folder (rows k, v by cell), and per cell its centre, the widest cosine of a member, and its size. The
    last cell has no centre: zero vectors, whose score is 0."""

    path: str
    centres: np.ndarray
    widest: np.ndarray
    sizes: np.ndarray

    def rows(self, spark: SparkSession, cells: list[int]) -> DataFrame:
        return spark.read.parquet(self.path).where(F.col("cell").isin(cells))

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """Upper bounds (queries x cells) on the scores of the cells' vectors."""
        angle = np.arccos(np.clip(unit @ self.centres.T, -1, 1)) - np.arccos(np.clip(self.widest, -1, 1))
        bound = np.cos(np.maximum(0, angle))
        bound[~unit.any(1)] = 0.0
        return np.concatenate([bound, np.zeros((len(unit), 1))], 1)


def fit_centres(sample: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Unit centres of the unit vectors ``sample``; a centre that nothing is near to stays where it is."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(1)
        for c in np.unique(near):
            mean = sample[near == c].mean(0)
            if (norm := np.linalg.norm(mean)) > 1e-9:
                centres[c] = mean / norm
    return centres


def build_index(index: DataFrame, vec: str = "embedding", key: str = "id", cells: int = CELLS, path: str | None = None) -> CellIndex:
    """Store ``index`` by cell. Centres are fitted on a hash-drawn sample of about SAMPLE_PER_CELL vectors a cell, every vector is stored;
    null vectors are left out. All vectors must be equally long."""
    spark = index.sparkSession
    show_code(spark)
    normed = index.where(F.col(vec).isNotNull()).select(F.col(key).alias("k"), normalize(vec).alias("v"))
    some = F.exists("v", lambda x: x != 0)
    n = normed.where(some).count()
    cells = max(1, min(cells, int(n ** 0.5)))
    share = min(1.0, SAMPLE_PER_CELL * cells / max(n, 1))
    drawn = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1)
    sample = np.array([r["v"] for r in normed.where(some & drawn).select("v").collect()], np.float64)
    centres = fit_centres(sample, min(cells, len(sample))) if len(sample) else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch.column("v").to_pylist(), np.float64).reshape(len(batch), -1)
            cell, cosine = np.full(len(x), len(sent.value)), np.zeros(len(x))
            live = x.any(1)
            if len(sent.value) and live.any():
                scores = x[live] @ sent.value.T
                cell[live], cosine[live] = scores.argmax(1), scores.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cosine), pa.array(cell.astype(np.int32))], ["k", "v", "cosine", "cell"])

    path = path or shared_path(spark, f"cells-{uuid.uuid4().hex}")
    placed = normed.mapInArrow(assign, f"k {dict(index.dtypes)[key]}, v array<double>, cosine double, cell int")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    widest, sizes = np.ones(len(centres)), np.zeros(len(centres) + 1, np.int64)
    for r in spark.read.schema(placed.schema).parquet(path).groupBy("cell").agg(F.min("cosine").alias("low"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        sizes[r["cell"]] = r["n"]
        if r["cell"] < len(centres):
            widest[r["cell"]] = r["low"]
    return CellIndex(path, centres, widest, sizes)


def topk(spark: SparkSession, ix: CellIndex, queries: DataFrame, k: int, key: str = "id", qid: str = "qid", qvec: str = "query") -> tuple[DataFrame, list[float]]:
    """((key, qid, score, rank), shares): the ``k`` best per query, exact, ties to the smaller key, as ``vectors.topk_batch``; and the share
    of all (query, vector) pairs that each pass over the queries had to score.

    Queries are read in blocks, as there; null queries are left out. Any index and any queries work: where bounds rule out nothing, all cells are read.
    """
    asked = queries.where(F.col(qvec).isNotNull()).select(F.col(qid).alias("q"), normalize(qvec).alias("v"))
    n, dim = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    passes = max(1, -(-n // max(1, min(PASS_BYTES // (8 * dim), PASS_CELLS // k))))
    types = [to_arrow_type(spark.read.parquet(ix.path).schema["k"].dataType), to_arrow_type(queries.schema[qid].dataType)] if ix.sizes.sum() else [pa.int64(), pa.int64()]
    out, shares = None, []
    for p in range(passes):
        rows = (asked if passes == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p)).collect()
        if not rows or not ix.sizes.sum():
            continue
        names, unit = [r["q"] for r in rows], np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1)
        bound = ix.bounds(unit) if len(ix.centres) else np.zeros((len(unit), 1))
        order = np.argsort(-bound, axis=1, kind="stable")
        seen = np.cumsum(ix.sizes[order], axis=1) - ix.sizes[order] < k  # the best cells that hold the first k vectors
        first = np.zeros_like(seen)
        np.put_along_axis(first, order, seen, axis=1)
        hits = _round(spark, ix, first, names, unit, k, types, [key, qid, "score"], dict(queries.dtypes)[qid])
        path = shared_path(spark, f"cell-hits-{uuid.uuid4().hex}")
        hits.write.parquet(path)
        hits = spark.read.schema(hits.schema).parquet(path)
        kth = {r[qid]: r["s"] for r in _ranked(hits, key, qid, k).groupBy(qid).agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()}
        floor = np.array([kth.get(x, -2.0) for x in names])
        second = (bound + SLACK >= floor[:, None]) & ~first & (ix.sizes > 0)
        shares.append(float(((first | second) @ ix.sizes).sum() / (len(names) * ix.sizes.sum())))
        if second.any():
            hits = hits.unionByName(_round(spark, ix, second, names, unit, k, types, [key, qid, "score"], dict(queries.dtypes)[qid]))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        kind = dict(spark.read.parquet(ix.path).dtypes).get("k", "long") if ix.sizes.sum() else "long"
        out = spark.createDataFrame([], f"`{key}` {kind}, `{qid}` {dict(queries.dtypes)[qid]}, score double")
    return _ranked(out, key, qid, k), shares


def _ranked(hits: DataFrame, key: str, qid: str, k: int) -> DataFrame:
    w = Window.partitionBy(qid).orderBy(F.round("score", RANK_DIGITS).desc(), F.col(key).asc())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _round(spark: SparkSession, ix: CellIndex, wanted: np.ndarray, names: list, unit: np.ndarray, k: int, types: list[pa.DataType], columns: list[str], qid_type: str) -> DataFrame:
    """The k best of each query in each task among the wanted cells (queries x cells); only those cells' folders are read."""
    sent = spark.sparkContext.broadcast((names, unit, wanted))
    rows = ix.rows(spark, np.flatnonzero(wanted.any(0)).tolist()).select("k", "v", "cell")
    schema = f"`{columns[0]}` {dict(rows.dtypes)['k']}, `{columns[1]}` {qid_type}, {columns[2]} double"
    return rows.mapInArrow(_best_in_cells(sent, k, columns, types), schema)


def _best_in_cells(sent, k: int, columns: list[str], types: list[pa.DataType]) -> Callable:
    def run(batches):
        names, unit, wanted = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # query -> keys and scores, best first
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            keys, x = np.array(batch.column("k").to_pylist(), object), batch.column("v")
            for cell in np.unique(cells):
                at, mine = np.flatnonzero(cells == cell), np.flatnonzero(wanted[:, cell])
                scores = np.array(x.take(pa.array(at)).to_pylist(), np.float64) @ unit[mine].T
                for q, column in zip(mine.tolist(), scores.T, strict=True):
                    had = best.get(q, (keys[:0], column[:0]))
                    cut = -np.inf if len(at) <= k else np.sort(column)[-k] - 10.0 ** -RANK_DIGITS  # ties with the k-th stay
                    some = np.flatnonzero(column >= cut)
                    both, s = np.concatenate([had[0], keys[at[some]]]), np.concatenate([had[1], column[some]])
                    order = np.argsort(both, kind="stable")
                    order = order[np.argsort(-np.round(s[order], RANK_DIGITS), kind="stable")][:k]
                    best[q] = both[order], s[order]
        for q, (found, s) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), types[0]), pa.array([names[q]] * len(found), types[1]), pa.array(s)], columns)

    return run
