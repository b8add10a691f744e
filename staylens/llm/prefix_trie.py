"""Prefix trie of conversations: distributed numbering of turns, nodes by prefix hash, and subtree totals rolled up by bands
of depth: nodes go to their ancestors inside a band of fixed height, completed totals of band roots go on to the band above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, stage

#: Depths of a band: a node goes to at most so many ancestors at once.
BAND = 8
#: Conversation ids are gathered in runs of so many consecutive numbers.
ID_RUN = 4096
#: Leading characters of role and text that may tell equal turns apart when rows are dealt to tasks.
LEAD = 64

_KEY = ["d", "p1", "p2"]


def _running(rows: DataFrame, dealt: list[Column], order: list[Column], key: str, extra: str, made: Callable[[pa.RecordBatch], tuple[list[np.ndarray], list]],
             op: np.ufunc, name: str) -> DataFrame:
    """Running totals within each ``key`` of rows in ``order``: ``made(batch)`` gives the values and the columns of ``extra``;
    ``op`` is np.add or np.bitwise_xor. Rows are dealt to tasks by ranges of ``dealt``, so a long key spreads over tasks; each task totals
    its own rows, and what a key has in the tasks before is added by a table of one row a task.
    Returns (key, the totals v0, v1, ..., and the columns of ``extra``).
    """
    spark = rows.sparkSession
    n = len(made(pa.RecordBatch.from_pylist([], _arrow(rows)))[0])
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        total, alone, task, out = np.zeros(n, np.int64), True, TaskContext.get().partitionId(), None
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(key)
            whole, columns = made(batch)
            code = keys.dictionary_encode().indices.to_numpy()
            begins = np.concatenate([[True], np.diff(code) != 0])
            first = keys[0].as_py() if first is None else first
            begins[0] = last is None or keys[0].as_py() != last
            at = np.flatnonzero(begins)
            run_of = np.cumsum(begins)  # 0: the run that goes on from the batch before
            opened = (run_of <= (0 if last is not None else 1)) & alone
            sums = []
            for k, value in enumerate(whole):
                upto = op.accumulate(value)
                before = np.concatenate([[0], np.where(at > 0, upto[at - 1], 0)])[run_of]
                mine = upto - before if op is np.add else upto ^ before
                mine[run_of == 0] = op(mine[run_of == 0], total[k])
                total[k] = mine[-1]
                sums.append(mine)
            alone = alone and not (begins[1:].any() or begins[0] and last is not None)
            last = keys[len(keys) - 1].as_py()
            out = pa.RecordBatch.from_arrays([keys, *map(pa.array, sums), *columns, pa.array(np.full(len(batch), task, np.int32)), pa.array(opened),
                                              pa.nulls(len(batch), keys.type), pa.nulls(len(batch), pa.bool_())], names)
            yield out
        if out is not None:  # what the task's last key has here, the task's first key, and whether there is no other
            row = {c: None for c in names} | {key: last, "first": first, "alone": alone, "task": task} | {f"v{k}": int(total[k]) for k in range(n)}
            yield pa.RecordBatch.from_pylist([row], out.schema)

    schema = f"{key} {key_type}, " + "".join(f"v{k} long, " for k in range(n)) + f"{extra}, task int, open boolean, first {key_type}, alone boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    found = stage(rows.repartitionByRange(partitions(spark), *dealt).sortWithinPartitions(*order).mapInArrow(run, schema), name)
    values = [f"v{k}" for k in range(n)]
    carry, last, total = [], None, [0] * n
    for r in found.where("alone is not null").select("task", key, "first", "alone", *values).orderBy("task").collect():
        goes_on = last is not None and r["first"] == last
        if goes_on:
            carry.append((r["task"], *total))
        mine = [r[v] for v in values]
        if goes_on and r["alone"]:
            mine = [a + b if op is np.add else a ^ b for a, b in zip(mine, total, strict=True)]
        last, total = r[key], mine
    before = spark.createDataFrame(carry, "task int, " + ", ".join(f"b{k} long" for k in range(n)))
    rows = found.where("alone is null").join(F.broadcast(before), "task", "left")  # a row a task, at most
    more = [F.when(F.col("open"), F.coalesce(f"b{k}", F.lit(0))).otherwise(0) for k in range(n)]
    return rows.select(key, *((F.col(v) + m if op is np.add else F.col(v).bitwiseXOR(m)).alias(v) for v, m in zip(values, more, strict=True)),
                       *names[n + 1 : -4])


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def number_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, r1, r2, words) of every turn: its conversation, its place (from 1) by turn (null first), role and text, a 128-bit hash of
    role and text, and the words of the text.

    Null roles and texts are empty. Rows with a null conversation id belong to no conversation and are left out. The turns of a long
    conversation are dealt over tasks by turn, then by the first characters of role and text.
    """
    rows = turns.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    short = F.length("role") <= LEAD  # else the next key would not follow the order of the whole roles
    dealt = [F.col("c"), F.col("turn").asc_nulls_first(), F.substring("role", 1, LEAD + 1), F.when(short, F.substring("text", 1, LEAD)).otherwise("")]

    def made(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list]:
        roles, texts = (batch.column(x).cast(pa.binary()).to_pylist() for x in ("role", "text"))
        digest = b"".join(hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16).digest() for r, t in zip(roles, texts, strict=True))
        h = np.frombuffer(digest, np.int64).reshape(-1, 2)
        return [np.ones(len(batch), np.int64)], [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array([len(t.split()) for t in texts], pa.int64())]

    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return _running(rows, dealt, order, "c", "r1 long, r2 long, words long", made, np.add, "trie-turns").withColumnRenamed("v0", "pos")


def share_heads(numbered: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Numbered turns in which every conversation c begins with the first h turns of the first of its family, c - c % family (all if it
    has fewer, none if there is none), and goes on with its own turns after its first h; h = crc32(decimal c) % most.
    Returns the turns (c, pos, r1, r2, words) and the conversations (c, size), turnless ones too."""
    first = F.col("c") - F.col("c") % family
    own = numbered.groupBy("c").agg(F.max("pos").alias("n"))
    own = stage(own.select("c", "n", first.alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % most).alias("h")), "trie-sizes")
    bases = own.where("c = base").select("base", F.col("n").alias("m"))
    kept = F.least("h", F.coalesce("m", F.lit(0)))
    convs = own.join(bases, "base", "left").select("c", "base", "h", kept.alias("k"), (kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    convs = stage(convs, "trie-convs")
    columns = ["r1", "r2", "words"]
    rest = numbered.join(convs.select("c", "h", "k"), "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), *columns)
    heads = numbered.where((F.col("pos") < most) & (F.col("c") == first))
    heads = heads.withColumnRenamed("c", "base").join(convs.where("k > 0").select("c", "base", "k"), "base").where("pos <= k")  # a family has few members
    return rest.unionByName(heads.select("c", "pos", *columns)), convs.select("c", "size")


def trie(numbered: DataFrame, convs: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes of the trie of numbered turns (c, pos, r1, r2, words) of the conversations (c, size); see ``prefix_trie``."""
    def made(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list]:
        pos = batch.column("pos").to_numpy().astype(np.uint64)
        h = [mix64(batch.column(r).to_numpy().view(np.uint64) + pos * np.uint64(f)).view(np.int64)
             for r, f in (("r1", 0x9E3779B97F4A7C15), ("r2", 0xD1B54A32D192ED03))]
        return h, [batch.column("pos"), *map(pa.array, h), batch.column("words")]

    # the hash of a prefix: the exclusive or of its turns' hashes, each mixed with its place
    keys = [F.col("c"), F.col("pos")]
    found = _running(numbered, keys, keys, "c", "d long, w1 long, w2 long, words long", made, np.bitwise_xor, "trie-prefixes")
    found = found.select("c", "d", F.col("v0").alias("p1"), F.col("v1").alias("p2"), F.col("v0").bitwiseXOR(F.col("w1")).alias("q1"), F.col("v1").bitwiseXOR(F.col("w2")).alias("q2"), "words")
    places = found.select("c", *_KEY).union(convs.select("c", *(F.lit(0).cast("long").alias(k) for k in _KEY)))
    nodes = found.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("c"), *(F.max(x).alias(x) for x in ("q1", "q2", "words")))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("c")).where("n_convs > 0")
    nodes = nodes.unionByName(root.select(*(zero.alias(k) for k in [*_KEY, "words"]), "n_convs", "c", none.alias("q1"), none.alias("q2")))
    nodes = stage(nodes, "trie-nodes")
    above = (F.col("d") - 1).alias("d")
    below = nodes.where("d > 0").groupBy(above, F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(below.hint("merge"), _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-children")
    own = nodes.select("c", *_KEY, (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = _rolled_up(own, places, nodes.agg(F.max("d")).first()[0] or 0, band)
    # parents: the root's children are many, so it goes as a value
    top = nodes.where("d = 0").select("c").first()
    parents = nodes.where("d > 0").select(F.col("d").alias("pd"), F.col("p1").alias("pp1"), F.col("p2").alias("pp2"), F.col("c").alias("parent"))
    deep = nodes.where("d > 1").join(parents.hint("merge"), (F.col("d") - 1 == F.col("pd")) & (F.col("q1") == F.col("pp1")) & (F.col("q2") == F.col("pp2")))
    flat = nodes.where("d <= 1").withColumn("parent", F.when(F.col("d") == 1, F.lit(top and top["c"]).cast("long")))
    named = flat.unionByName(deep.drop("pd", "pp1", "pp2"))
    return (named.join(totals.select(*_KEY, "leaves", "saved").hint("merge"), _KEY).join(_ends(places, convs).hint("merge"), _KEY, "left")
            .select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                    F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", band: int = BAND) -> DataFrame:
    """The trie of whole conversations: a row per distinct sequence of first turns (role, text), the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node is the first ``depth`` turns of its
    smallest member ``conv_id``. ``n_leaves`` counts the childless nodes of its subtree, ``saved_tokens`` sums (n_convs - 1) times the words
    of the last text over it, ``ends_sha256`` is of the ids, rising and comma-joined, of the conversations that end here.

    Turns are numbered by turn (null first), role and text; null roles and texts are empty; rows with a null conversation id are
    left out; repeated rows are turns of their own; other columns are ignored; no conversations, no nodes. Conversation ids are whole numbers.
    """
    numbered = number_turns(turns, conv_id, turn, role, text)
    return trie(numbered, numbered.groupBy("c").agg(F.max("pos").alias("size")), band)


def _ancestors(nodes: DataFrame, places: DataFrame, step: int, band: int, same: bool) -> DataFrame:
    """Each node's values at each of its ancestors (itself too) of a depth divisible by ``step`` in its own band of ``band`` steps, or
    those in the band above: the places of its smallest member, at most ``band`` of them."""
    height = step * band
    up = places.where(F.col("d") % step == 0).select("c", F.floor(F.col("d") / height).alias("b"), *(F.col(k).alias("a" + k) for k in _KEY))
    mine = nodes.withColumn("b", F.floor(F.col("d") / height) - (0 if same else 1))
    pairs = mine.join(up, ["c", "b"]).where("ad <= d")
    return pairs.groupBy(*(F.col("a" + k).alias(k) for k in _KEY)).agg(F.min("c").alias("c"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _rolled_up(own: DataFrame, places: DataFrame, deepest: int, band: int) -> DataFrame:
    """``own`` with leaves and saved summed over subtrees.

    Upwards, a level's nodes give their totals to the ancestors in their band; its band roots are the nodes of the next level, whose bands
    are ``band`` times as high. The top level has one band, so its totals are complete. Downwards, the completed totals of a level's band
    roots go to their ancestors in the band above. Rounds: twice the logarithm of the depth; rows of a round: at most ``band`` a node.
    """
    step, levels = 1, []
    level = own
    while True:
        levels.append((step, stage(_ancestors(level, places, step, band, True), "trie-up")))
        if deepest < step * band:
            break
        step *= band
        level = levels[-1][1].where(F.col("d") % step == 0)
    done = levels.pop()[1]
    while levels:
        step, inside = levels.pop()
        more = _ancestors(done.where("d > 0"), places, step, band, False)
        done = stage(inside.unionByName(more).groupBy(*_KEY).agg(F.min("c").alias("c"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-down")
    return done


def _ends(places: DataFrame, convs: DataFrame) -> DataFrame:
    """(d, p1, p2, ends): the digest of the conversations that end at a node. Ids are gathered in runs of consecutive numbers, at most ID_RUN
    of them; the runs of a node stream in order through one task, which holds a digest and one run."""
    spark = places.sparkSession
    last = places.join(convs.withColumnRenamed("size", "d"), ["c", "d"])
    run_of = (F.col("c") - F.pmod("c", F.lit(ID_RUN))).alias("run")
    runs = last.groupBy(*_KEY, run_of).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            out = []
            for *now, ids in zip(*(batch.column(k).to_pylist() for k in [*_KEY, "ids"]), strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = now, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            if out:
                yield _node_rows(out)
        if key is not None:
            yield _node_rows([(*key, h.hexdigest())])

    dealt = runs.repartition(partitions(spark), *_KEY).sortWithinPartitions(*_KEY, "run")
    return dealt.mapInArrow(digest, "d long, p1 long, p2 long, ends string")


def _node_rows(rows: list[tuple]) -> pa.RecordBatch:
    d, p1, p2, ends = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (d, p1, p2)), pa.array(ends)], [*_KEY, "ends"])
