"""Mixing sources to target weights: fixed-length token blocks, per-source pseudorandom index permutations, one
permutation that deals the sources' slots to output shards, blocks joined by index."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks_for, by_block, mix64, partitions, shared_path, stage

WEIGHTS = (5, 2, 1)
BLOCK = 64
EPOCHS = 3
SHARD_SLOTS = 1 << 16
SEED = 20240601

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a block's rows, in order, and the n + 1 offsets of the rows' words."""
    word = np.concatenate([~_BLANK[data], [False]])
    begins = at[:-1][at[:-1] < at[1:]]
    start, stop = word[:-1].copy(), word[:-1] & ~word[1:]
    start[1:] &= ~word[:-2]
    start[begins] = word[begins]
    stop[at[1:][at[:-1] < at[1:]] - 1] = word[at[1:][at[:-1] < at[1:]] - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, at)


def word_counts(docs: DataFrame, text: str = "text", name: str = "_size", packed: str | None = None) -> DataFrame:
    """``docs`` without ``text``, plus the number of words ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: 0) and, in ``packed``,
    the text's bytes, compressed, behind their number (8 bytes)."""
    old = [c for c in docs.columns if c not in (text, name)]

    def block(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.Table:
        out = {**{c: rows.column(c) for c in old}, name: np.diff(word_bounds(data, at)[2])}
        if packed:
            raw, codec = data.tobytes(), pa.Codec("zstd")
            out[packed] = pa.array([int(b - a).to_bytes(8, "little") + codec.compress(raw[a:b], asbytes=True) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
        return pa.table(out)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in old) + f", `{name}` long" + (f", `{packed}` binary" if packed else "")
    return by_block(docs, schema, block, text)


def water_fill(sizes: list[int], weights: list[float], epochs: int) -> list[float]:
    """Targets in proportion to the weights that add up to all sizes, none above ``epochs`` times its size:
    the excess is shared anew by weight among the others until none is above."""
    target = [0.0] * len(sizes)
    rest, open_ = float(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if rest * weights[k] / total > epochs * sizes[k]}
        for k in full or open_:
            target[k] = float(epochs * sizes[k]) if full else rest * weights[k] / total
        if not full:
            break
        rest -= sum(target[k] for k in full)
        open_ -= full
    return target


def permute(index: np.ndarray, size: int | np.ndarray, key: int | np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of ``range(size)`` at ``index``: four Feistel rounds on the next even power of
    two, walking the cycle until the value is in range. Size and key may differ by element."""
    out = index.astype(np.uint64)
    size = np.broadcast_to(np.asarray(size, np.int64), out.shape)
    salt = np.broadcast_to(np.asarray(key, np.int64), out.shape).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    half = np.maximum(1, (np.frexp(np.maximum(size - 1, 1).astype(np.float64))[1] + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & low[todo]
        for k in range(4):
            left, right = right, left ^ mix64(right + salt[todo] + np.uint64(k * 0xD1B54A32D192ED03 % (1 << 64))) & low[todo]
        out[todo] = left << half[todo] | right
        todo = todo[out[todo].astype(np.int64) >= size[todo]]
    return out.astype(np.int64)


def shard_counts(shards: np.ndarray, slots: int, shares: np.ndarray, seed: int) -> np.ndarray:
    """Source counts of output shards of ``slots`` slots: the whole part of each expected count, and a systematic draw, seeded by the
    shard's number, for the slots that the whole parts leave. A source gets less than one slot more or less than it
    should, and on average what it should."""
    expected = shares * slots
    whole = np.floor(expected * (1 + 1e-12) + 1e-9)
    left = np.maximum(expected - whole, 0)
    n = slots - int(whole.sum())
    out = np.tile(whole.astype(np.int64), (len(shards), 1))
    if n > 0 and left.sum() > 0:
        for row, shard in zip(out, shards, strict=True):
            rng = np.random.default_rng([seed, int(shard)])
            order = rng.permutation(len(left))
            upto = np.cumsum(left[order]) * (n / left.sum())
            upto[-1] = n
            row[order] += np.diff(np.floor(np.concatenate([[0], upto]) + rng.random()).astype(np.int64))
    return out


def mix_sources(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", weights: tuple = WEIGHTS,
                epochs: int = EPOCHS, block: int = BLOCK, slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The documents of ``mix_corpus``: how many words the mix takes of each."""
    return mix_corpus(docs, source, text, doc_id, weights, epochs, block, slots, seed)[1]


def mix_corpus(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", weights: tuple = WEIGHTS, epochs: int = EPOCHS,
               block: int = BLOCK, slots: int = SHARD_SLOTS, seed: int = SEED, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mix all documents by source. Returns the mixed corpus and the documents.

    The corpus has a row per filled slot, in files in the order of ``shard`` and ``slot``: shard, slot, source, ``source_index``,
    ``block`` (its number in the source), ``n_words``, ``text`` (the block's words as they stand in the documents, a line end between
    documents) and ``parts`` (``start`` of the document in its source's stream, ``doc_id`` and ``words``, in the text's order). It is written to ``path`` (else to the shared folder).
    The documents have a row per row of ``docs``: doc_id, source, ``size`` (words), ``source_size``, ``target`` (words of
    its source in the mix) and ``taken`` (words of it that the written corpus holds, repeats counted).

    Sources (null is one, last) in code-point order weigh ``weights``, repeating; targets share all sizes and
    stop at ``epochs`` times a source's size (see ``water_fill``). A source's documents, in pseudorandom order,
    form one stream of words, cut into blocks of ``block`` words. A source's number of slots follows from its target (see
    ``slot_counts``); its slots run through a permutation of its blocks, a new one each epoch, so a block comes up to
    ``epochs`` times. One permutation deals all sources' slots to the places of the output, ``slots`` to a shard, so a shard's
    counts by source are a multinomial draw given the sources' totals. Pieces of documents meet by (shard, slot).

    The source table (a row per source) comes to the driver and goes to the tasks; nothing else does. Offsets of a source's
    documents come from sums over hash buckets, sized so that a bucket holds about a thousand documents whatever
    its source. ``docs`` is read twice, for sizes and for texts, which are shuffled compressed. Empty and null texts take nothing;
    repeated rows are documents of their own; reruns agree.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).alias("_id"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_text"))
    given = given.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_id").cast("string"), "_text"))
    sized = stage(word_counts(given, "_text", "_size"), "mix-sizes")
    table = [(r["_source"], r["n"] or 0, r["docs"]) for r in sized.groupBy("_source").agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()]
    table.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in table]
    targets = water_fill(sizes, [float(weights[k % len(weights)]) for k in range(len(table))], epochs)
    plan = spark.createDataFrame([(r[0], k, r[1], t) for k, (r, t) in enumerate(zip(table, targets, strict=True))],
                                 "_source string, _s int, source_size long, target double").withColumnRenamed("_source", "_name")
    # word offsets within a source: buckets of the order, then rows of a bucket
    bucket = F.pmod("_h", F.lit(blocks_for(sum(r[2] for r in table), 1024)))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(plan), rows["_source"].eqNullSafe(plan["_name"])).drop("_name").withColumn("_b", bucket)

    sums = dealt(sized).groupBy("_s", "_b").agg(F.sum("_size").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(sums.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "mix-starts")
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)

    def place(rows: DataFrame) -> DataFrame:
        rows = dealt(rows).withColumn("_off", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, ["_s", "_b"])
        return rows.withColumn("_start", F.col("_base") + F.col("_off")).drop("_b", "_h", "_base", "_off")

    placed = stage(place(sized), "mix-placed")
    texts = place(word_counts(given, "_text", "_size", "_packed").where("_size > 0")).select("_id", "_s", "_start", "_packed")
    numbers = -(-np.array(sizes, np.int64) // block)
    pieces = _pieces(texts, numbers, slot_counts(sizes, targets, epochs, block, seed), epochs, block, seed)
    parts = F.array_sort(F.collect_list(F.struct("_at", "_start", "_id", "_words", "_text")))
    corpus = (pieces.repartitionById(partitions(spark), F.col("_part")).groupBy("_part", "_to")
              .agg(F.first("_s").alias("_s"), F.first("block").alias("block"), parts.alias("p"))
              .join(F.broadcast(plan.select("_s", "_name")), "_s")
              .select(F.floor(F.col("_to") / slots).alias("shard"), (F.col("_to") % slots).alias("slot"), F.col("_name").alias(source), F.col("_s").alias("source_index"), "block",
                      F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["_words"]).alias("n_words"),
                      F.array_join("p._text", "\n").alias("text"),
                      F.transform("p", lambda x: F.struct(x["_start"].alias("start"), x["_id"].alias("doc_id"), x["_words"].alias("words"))).alias("parts"))
              .sortWithinPartitions("shard", "slot"))
    path = path or shared_path(spark, "llm", f"mix-corpus-{uuid.uuid4().hex}")
    corpus.write.option("compression", "zstd").parquet(path)
    corpus = spark.read.schema(corpus.schema).parquet(path)
    taken = (corpus.select(F.col("source_index").alias("_s"), F.explode("parts").alias("p")).groupBy("_s", F.col("p.start").alias("_start"))
             .agg(F.sum("p.words").alias("taken")))
    out = placed.join(taken.hint("merge"), ["_s", "_start"], "left")  # of the documents at one start, only the last has words
    return corpus, out.select(F.col("_id").alias(doc_id), F.col("_source").alias(source), F.col("_size").alias("size"), "source_size", "target",
                              F.when(F.col("_size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def slot_counts(sizes: list[int], targets: list[float], epochs: int, block: int, seed: int) -> np.ndarray:
    """Slots of each source in the mix, none above ``epochs`` times its blocks: on average its target over the words that its
    blocks hold on average, as the last block of a source is not full."""
    size = np.array(sizes, np.int64)
    numbers = -(-size // block)
    expected = np.array(targets, np.float64) * numbers / np.maximum(size, 1)
    total = int(np.ceil(expected.sum() - 1e-6))
    if total <= 0:
        return np.zeros(len(sizes), np.int64)
    shares = np.append(expected, max(0.0, total - expected.sum())) / total  # what is left of the last slot is nobody's
    return np.minimum(shard_counts(np.array([0]), total, shares, seed)[0][:-1], epochs * numbers)


def _pieces(texts: DataFrame, numbers: np.ndarray, counts: np.ndarray, epochs: int, block: int, seed: int) -> DataFrame:
    """A row for each piece of a document in a block and each slot of the block: place in the output and its file, block, the piece's place in the block, and its words."""
    firsts, total, files = np.cumsum(counts) - counts, int(counts.sum()), partitions(texts.sparkSession)

    def cut(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.Table:
        begins, ends, first = word_bounds(data, at)
        s, start, size = rows.column("_s").to_numpy(), rows.column("_start").to_numpy(), np.diff(first)
        n = (start + size - 1) // block - start // block + 1
        doc = np.repeat(np.arange(len(n)), n)
        number = start[doc] // block + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        lo, hi = np.maximum(start[doc], number * block), np.minimum((start + size)[doc], (number + 1) * block)
        place = first[:-1][doc] - start[doc]
        raw = data.tobytes()
        text = pa.array([raw[a:b] for a, b in zip(begins[lo + place].tolist(), ends[hi + place - 1].tolist(), strict=True)], pa.binary()).cast(pa.string())
        of, piece, to = s[doc], [], []
        for epoch in range(epochs):
            k = epoch * numbers[of] + permute(number, numbers[of], (of.astype(np.int64) << 20) + epoch + seed)
            used = np.flatnonzero(k < counts[of])
            piece.append(used)
            to.append(permute(firsts[of[used]] + k[used], total, seed))
        piece, to = np.concatenate(piece), np.concatenate(to)
        return pa.table({"_part": (to * files // total).astype(np.int32), "_to": to, "_s": of[piece], "block": number[piece],
                         "_at": (lo - number * block)[piece], "_start": start[doc[piece]],
                         "_id": rows.column("_id").take(doc[piece]), "_words": (hi - lo)[piece], "_text": text.take(piece)})

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            packed = batch.column("_packed").to_pylist()
            long = np.array([int.from_bytes(x[:8], "little") for x in packed], np.int64)
            ends = np.cumsum(long)
            cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK_BYTES)) + 1), len(packed)]  # a longer text ends a run
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    raw = b"".join(codec.decompress(x[8:], int(m), asbytes=True) for x, m in zip(packed[a:b], long[a:b], strict=True))
                    yield from cut(batch.slice(a, b - a), np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(long[a:b])])).to_batches()

    id_type = texts.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"_part int, _to long, _s int, block long, _at long, _start long, _id {id_type}, _words long, _text string")
