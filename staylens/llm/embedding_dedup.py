"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells, one row kept per group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, roots, stage

THRESHOLD = 0.9
#: Vectors that the cells are fitted on, and cells at most (each holds at least 16 of them).
SAMPLE = 20_000
#: Cells that a vector visits besides its own.
PROBES = 3
#: Rows of a block of a cell.
BLOCK = 1024
ROUNDS = 8


def fit_cells(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of spherical k-means (normalised rows in, ``ROUNDS`` rounds, empty cells restart at a row)."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        near = (sample @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        empty = norm < 1e-12
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        norm[empty] = 1
        centre = total / norm[:, None]
    return centre


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of equally long lists as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, exactly, so that no square or product of theirs overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def valid(embedding: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
                    probes: int = PROBES, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Two vectors link when their cosine, in double precision, is ``threshold`` or more. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id reachable by links and ``kept`` marks the
    row that bears it.

    Equal vectors are one class with a weight, so copies are never compared. Spherical k-means on at most
    ``sample`` classes (drawn by hash) gives about sqrt(classes) cells, at most sample / 16; every class
    is assigned its own cell and visits the next ``probes`` cells; a pair is compared where one of the two is
    at home, once. A cell of more than ``block`` rows is split into blocks and each pair of blocks is a group of
    its own, so a cell of any size spreads over tasks. A group returns, per class, the weight of its links and
    the smallest class it reaches inside the group: never pairs. Links across cells that neither vector visits
    are missed (recall is measured in the tests and the README).

    Null, zero and non-finite vectors, and vectors with null components, link with nothing; vectors of different lengths
    don't link. Rows with a null id take part, but a component bears the smallest id that isn't null; repeated
    rows and ids are vectors of their own. Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).alias("_id"), F.col(embedding).cast("array<double>").alias("_e"))
    classes = stage(rows.where(valid(F.col("_e"))).groupBy("_e").agg(F.count(F.lit(1)).alias("w"), F.min("_id").alias("rep"))
                    .select(F.monotonically_increasing_id().alias("cid"), "_e", "w", "rep"), "vectors")
    made = _cells(classes, probes, sample, block)
    links = stage(_compare(made, threshold, block), "links")
    found = links.groupBy("cid").agg(F.sum("links").alias("links"))
    nodes = components(links.where("cid != root"), "cid", "root", "vector-links")
    rep = classes.select("cid", "rep", "w")
    named = nodes.join(rep, nodes["node"] == rep["cid"]).groupBy("component").agg(F.min("rep").alias("name"))
    named = nodes.join(named, "component").select(F.col("node").alias("cid"), "name")
    per_class = (classes.join(found, "cid", "left").join(named, "cid", "left")
                 .select("_e", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("name", "rep").alias("c")))
    out = rows.join(per_class, "_e", "left")
    component = F.coalesce("c", "_id")
    return out.select(F.col("_id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))


def _cells(classes: DataFrame, probes: int, sample: int, block: int) -> DataFrame:
    """(unit, cell, at, cid, w, visits, _e): each class in every pair of blocks (unit) of its cell and visited cells."""
    spark = classes.sparkSession
    total = classes.count()
    drawn = classes.select("_e")
    if total > sample:  # about ``sample`` of them by hash, whatever the number of tasks
        drawn = drawn.where(F.pmod(F.xxhash64("_e"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    drawn = drawn.toArrow().column("_e").combine_chunks()
    sizes = np.array([len(x) for x in drawn], np.int64)
    centres: dict[int, tuple[int, np.ndarray]] = {}
    first = 0
    for dim in np.unique(sizes).tolist():
        x = matrix(drawn.filter(pa.array(sizes == dim)))
        k = max(1, min(int(math.sqrt(total)), len(x) // 16))
        x /= np.abs(x).max(1, keepdims=True)  # no overflow in the norm
        centres[dim] = first, fit_cells(x / np.linalg.norm(x, axis=1, keepdims=True), k)
        first += k
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            lists = batch.column("_e")
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes):
                mask = pa.array(sizes == dim)
                part, x = batch.filter(mask), matrix(lists.filter(mask))
                x /= np.abs(x).max(1, keepdims=True)
                # vectors of a length that the sample doesn't hold share one cell of their own
                start, centre = sent.value.get(int(dim), (-1 - int(dim), np.zeros((1, int(dim)))))
                order = np.argsort(-(x @ centre.T), axis=1, kind="stable")[:, : probes + 1] + start
                n, width = order.shape
                at = np.repeat(np.arange(n), width)
                visits = pa.ListArray.from_arrays(np.arange(0, (n * width + 1) * width, width, dtype=np.int32), pa.array(order[at].ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), *(part.column(c).take(pa.array(at)) for c in ("cid", "w")), visits,
                                                  lists.filter(mask).take(pa.array(at))], ["cell", "cid", "w", "visits", "_e"])

    placed = stage(classes.select("cid", "w", "_e").mapInArrow(assign, "cell int, cid long, w long, visits array<int>, _e array<double>"), "cells")
    heavy = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    return (placed.join(heavy, "cell").withColumn("at", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("cell", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "cid", "w", "visits", "_e"))


def _compare(units: DataFrame, threshold: float, block: int) -> DataFrame:
    """(cid, links, root) of the classes that link inside a unit; its pairs are those between its two blocks."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        col = {c: group.column(c).to_numpy() for c in ("cid", "w", "at")}
        cell, i, j = (group.column(c)[0].as_py() for c in ("cell", "i", "j"))
        x = scaled(matrix(group.column("_e").combine_chunks()))
        visits = group.column("visits").combine_chunks()
        visits = visits.flatten().to_numpy().reshape(len(x), -1)
        home = visits[:, 0]
        norm = np.sqrt((x * x).sum(1))
        n = len(x)
        links, linked = np.zeros(n, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        left = np.flatnonzero(col["at"] == i)
        right = np.flatnonzero(col["at"] == j)
        for lo in range(0, len(left), block):
            for ro in range(0, len(right), block):
                a, b = left[lo : lo + block], right[ro : ro + block]
                near = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b]) >= threshold
                p, q = np.nonzero(near)
                p, q = a[p], b[q]
                keep = (p < q) if i == j else np.ones(len(p), bool)
                # a pair that meets in two cells counts in the lower one
                hp, hq = home[p], home[q]
                keep &= (hp == cell) | (hq == cell)
                away = np.where(hp == cell, hq, hp)
                inner = np.where(hp == cell, p, q)  # the one at home here
                twice = (visits[inner] == away[:, None]).any(1) & (away != cell)
                p, q = (v[keep & ~(twice & (away < cell))] for v in (p, q))
                np.add.at(links, p, col["w"][q])
                np.add.at(links, q, col["w"][p])
                linked += [(p, q)]
        root = roots(*(np.concatenate([x[k] for x in linked]) for k in (0, 1)), n)
        seen = links > 0
        return pa.table({"cid": col["cid"][seen], "links": links[seen], "root": col["cid"][root[seen]]})

    return units.groupBy("cell", "i", "j").applyInArrow(compare, "cid long, links long, root long")
