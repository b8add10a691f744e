"""Helpers of the operators: scratch tables, byte blocks of a text column, row keys, connected components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.session import shared_path, show_code  # noqa: F401

BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and read it back: cuts the lineage
    and survives lost executors. The folders live below the shared folder and expire with it."""
    path = shared_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` bears (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (null: empty) and the n + 1 offsets of its rows."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def byte_blocks(text: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most about ``most`` bytes; a longer text
    is a run of its own."""
    data, at = as_bytes(text)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def by_block(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.Table | None],
             text: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """Apply ``f(rows, bytes, offsets)`` to each block of rows of every Arrow batch; no shuffle."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in byte_blocks(batch.column(text), most):
                out = f(batch.slice(lo, hi - lo), data, at)
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def word_table(kept: Callable[[int], bool]) -> bytes:
    """A ``bytes.translate`` table that lower-cases A-Z and turns bytes outside words into blanks."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if kept(b) else 32 for b in range(256))


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, a-z and all non-ASCII characters.
ALNUM_WORDS = word_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_WORDS).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (xor-shift and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n nodes' component under the links a[k] - b[k]: hook roots, then jump, until nothing moves."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            return root


def components(edges: DataFrame, a: str, b: str, name: str = "links") -> DataFrame:
    """(node, component) for every node of the undirected ``edges``: component is the smallest reachable node.

    Alternating large-star and small-star steps on staged edge tables: each step is a groupBy on the node
    with a min, so no neighbourhood is ever gathered and a hub costs one partial row per task; no edges are broadcast.
    It ends when every node hangs on one node that hangs on none.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = stage(edges.select(u, v).where("u != v").distinct(), name)
    while not _are_stars(e):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour joins the smallest node around
        e = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself join the smallest of them
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least.hint("merge"), "u")
        e = stage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
                  .where("u != v").distinct(), name)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(e: DataFrame) -> bool:
    one = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return one and e.join(e.select(F.col("u").alias("w")).hint("merge"), F.col("v") == F.col("w"), "left_semi").isEmpty()


def blocks_for(total: float, each: float) -> int:
    """Number of parts of about ``each`` that hold ``total``."""
    return max(1, math.ceil(total / each))
