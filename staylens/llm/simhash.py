"""Document fingerprints (SimHash): weighted term hashes vote on signed bits; permuted block tables find all fingerprints within a
Hamming radius."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_block, byte_blocks, components, fresh_name, mix64, partitions, roots, stage
from .hashing import prefix_sums, shingle_sets
from .source_mix import word_bounds

#: Bits of a fingerprint, words of a shingle, and the weights of a word and of a shingle.
BITS, WORDS = 128, 5
WORD_WEIGHT, SHINGLE_WEIGHT = 1, 2
#: Fingerprints that differ in at most so many bits link.
RADIUS = 4
#: Fingerprints of one block of a table's bucket; buckets of more are compared block by block.
BLOCK = 1 << 14
#: Bytes of text, and term hashes with their bits, that a task holds at once.
TEXT_BYTES, STEP = 1 << 20, 1 << 13


def fingerprints(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The fingerprints (rows of BITS / 8 bytes) of the texts ``data[at[k]:at[k + 1]]``.

    Terms are the text's words (A-Z as a-z), each with a weight that grows with the logarithm of its count, and its distinct shingles of ``words``
    words. A term's hash adds its weight to the votes of its set bits and takes it from the others; a bit is set if its votes are above 0.
    No terms, no bits.
    """
    n = len(at) - 1
    start, end, first = word_bounds(data, at)
    doc = np.repeat(np.arange(n), np.diff(first))
    h, down = prefix_sums(data, lower=True)
    word = mix64((h[end] - h[start]) * down[start])
    order = np.lexsort((word, doc))
    word, doc = word[order], doc[order]
    begins = np.ones(len(doc), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(doc)))
    docs, shingles = shingle_sets(data, at, words)
    of = np.concatenate([doc[first], docs])
    terms = np.concatenate([word[first], mix64(shingles + np.uint64(words))])
    weight = np.concatenate([WORD_WEIGHT * (1 + np.log2(np.maximum(count, 1)).astype(np.int64)), np.full(len(docs), SHINGLE_WEIGHT)]).astype(np.float32)
    order = np.argsort(of, kind="stable")
    of, terms, weight = of[order], terms[order], weight[order]
    votes = np.zeros((n, BITS), np.float64)
    for lo in range(0, len(of), STEP):
        part = slice(lo, lo + STEP)
        lanes = np.stack([mix64(terms[part] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(BITS // 64)], 1)
        signs = np.unpackbits(lanes.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(of[part])) + 1, [len(signs)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # whole numbers: sums are exact in any order
            votes[of[lo + a]] += weight[lo + a : lo + b] @ signs[a:b]
    return np.packbits(votes > 0, axis=1)


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of fingerprints differ."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _hex(prints: np.ndarray) -> list[str]:
    return [p.tobytes().hex() for p in prints]


def _binary(prints: np.ndarray) -> pa.Array:
    return pa.array([p.tobytes() for p in prints], pa.binary())


def fingerprint(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` plus ``_fingerprint`` (hex) of the whole text (null: empty): equal texts have equal ones. A column of that name is
    replaced; nothing is shuffled."""
    docs = docs.drop("_fingerprint")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns) + ", _fingerprint string"

    def block(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.Table:
        return pa.table({**{c: rows.column(c) for c in rows.schema.names}, "_fingerprint": _hex(fingerprints(data, at, words))})

    return by_block(docs, schema, block, text, TEXT_BYTES)


def half_edited(text: str, following: str) -> str:
    """The text whose last floor(n / 2) characters are the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``.

    A document is compared with its half-edited form (see ``half_edited``) and with the next document by falling doc_id (null last; after the
    last comes the first). Likeness is the share of equal bits.

    Rows of one id follow by text hash, then text. Rows are dealt by ranges of id and text hash, so one id may hold any share of the
    rows; each task walks its rows in order, and only its last row and its first one's text go into a table of two rows a
    task, where the last meets the first of the next task. Null texts are empty; a single row follows itself; other columns are ignored.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    dealt = [F.col("_id").desc_nulls_last(), F.col("_h")]
    schema = f"_id {id_type}, n_chars long, sha string, print binary, edited binary, following binary, task int, head string, tail string"
    names = [c.split()[0] for c in schema.split(", ")]

    def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return as_bytes(pa.array(texts, pa.large_string()))

    def described(ids: pa.Array, texts: list[str], prints: np.ndarray) -> pa.RecordBatch:
        """Rows for all texts but the last, which only follows."""
        n = len(texts) - 1
        edited = [half_edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        columns = [ids, pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                   _binary(prints[:-1]), _binary(fingerprints(*joined(edited), words)), _binary(prints[1:]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None  # the task's first text; the id, text and print that wait for the next
        for batch in batches:
            for lo, hi, data, at in byte_blocks(batch.column("_text"), TEXT_BYTES):
                ids, texts, prints = batch.column("_id").slice(lo, hi - lo), batch.column("_text").slice(lo, hi - lo).to_pylist(), fingerprints(data, at, words)
                first = texts[0] if first is None else first
                if held is not None:
                    ids, texts, prints = pa.concat_arrays([held[0], ids]), [held[1], *texts], np.concatenate([held[2], prints])
                if len(texts) > 1:
                    yield described(ids[:-1], texts, prints)
                held = ids[-1:], texts[-1], prints[-1:]
        if held is not None:
            empty = pa.nulls(1, pa.string())
            yield pa.RecordBatch.from_arrays([held[0], pa.nulls(1, pa.int64()), empty, _binary(held[2]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                                              pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), pa.array([held[1]])], names)

    walked = stage(rows.repartitionByRange(partitions(docs.sparkSession), *dealt).sortWithinPartitions(*dealt, "_text").mapInArrow(walk, schema), "simhash-walk")
    ends = walked.where("task is not null")
    tasks = [r["task"] for r in ends.select("task").orderBy("task").collect()]  # a number a task
    follows = docs.sparkSession.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, next int")
    heads = ends.select(F.col("task").alias("next"), F.col("head").alias("_follows"))
    pairs = ends.select("task", "_id", F.col("tail").alias("_text")).join(follows, "task").join(heads, "next").select("_id", "_text", "_follows")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                texts = [batch.column("_text")[k].as_py(), batch.column("_follows")[k].as_py()]
                yield described(batch.column("_id").slice(k, 1), texts, fingerprints(*joined(texts), words))

    def likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, edited, following = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("print", "edited", "following"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n_chars"), batch.column("sha"), pa.array(_hex(own), pa.string()), pa.array(_hex(edited), pa.string()),
                                              pa.array(1 - differing_bits(own, edited) / BITS), pa.array(1 - differing_bits(own, following) / BITS)], out)

    out = [doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    told = walked.where("task is null").union(pairs.mapInArrow(meet, schema)).drop("task", "head", "tail")
    return told.mapInArrow(likeness, f"`{doc_id}` {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def block_tables(radius: int, blocks: int, bits: int = BITS) -> list[list[slice]]:
    """The block tables for a radius: two fingerprints that differ in at most ``radius`` bits agree wholly in some ``blocks - radius`` of
    their ``blocks`` blocks of bits; each choice of blocks is one table, keyed by their bits."""
    cuts = np.linspace(0, bits, blocks + 1).astype(int)
    whole = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [list(chosen) for chosen in itertools.combinations(whole, blocks - radius)]


def blocks_wanted(count: int, radius: int, bits: int = BITS) -> int:
    """The fewest blocks whose keys have some bits more than the fingerprints' number needs, so that strangers seldom share a bucket."""
    blocks = radius + 1
    while (blocks - radius) * (bits // blocks) < np.log2(max(count, 2)) + 2 and blocks < 2 * radius + 2:
        blocks += 1
    return blocks


def near_groups(prints: DataFrame, doc_id: str = "doc_id", column: str = "fingerprint", radius: int = RADIUS, block: int = BLOCK, blocks: int | None = None) -> DataFrame:
    """``prints`` plus ``n_near`` (other rows whose fingerprint differs in at most ``radius`` bits) and ``component_id`` (the smallest
    doc_id reachable by such links, its own included; ids that are null are never names).

    Equal fingerprints are one class with a weight. Each class goes into every block table, keyed by its bits in the table's blocks; the
    classes of a bucket are compared with each other, in pairs of blocks of at most ``block`` classes, each pair of blocks a group of its own. A
    pair that meets in several tables counts in the first. A group returns, per class, the weight of its links and the
    smallest class it reaches there, never pairs. All links within the radius are found. Rows with a null fingerprint link with nothing.
    """
    rows = prints.drop("n_near", "component_id")
    print_, id_ = F.col(f"`{column}`"), F.col(f"`{doc_id}`")
    classes = rows.where(print_.isNotNull()).groupBy(print_.alias("p")).agg(F.count(F.lit(1)).alias("w"), F.min(id_).alias("rep"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("cid"), F.unhex("p").alias("b"), "p", "w", "rep"), "simhash-classes")
    tables = block_tables(radius, blocks or blocks_wanted(classes.count(), radius))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            bits = np.unpackbits(whole, axis=1)
            for k, chosen in enumerate(tables):
                part = np.packbits(np.concatenate([bits[:, s] for s in chosen], 1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), k, np.int32)), _binary(part), *(batch.column(c) for c in ("cid", "w", "b"))], ["t", "key", "cid", "w", "b"])

    entries = stage(classes.select("cid", "w", "b").mapInArrow(keyed, "t int, key binary, cid long, w long, b binary"), "simhash-tables")
    sizes = entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sizes = stage(sizes.select("t", "key", F.ceil(F.col("m") / block).cast("int").alias("parts")), "simhash-buckets")  # staged: a hot bucket is then split in the join
    mine = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    units = (entries.join(sizes, ["t", "key"]).withColumn("at", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("t", "key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "cid", "w", "b"))

    def compare(group: pa.Table) -> pa.Table:
        t, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
        cid, weight, at = (group.column(c).to_numpy() for c in ("cid", "w", "at"))
        words = np.frombuffer(b"".join(group.column("b").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        masks = [np.frombuffer(_mask(chosen), np.uint64) for chosen in tables[:t]]
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        links, linked = np.zeros(len(cid), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lo in range(0, len(left), 256):
            a = left[lo : lo + 256]
            diff = words[a][:, None, :] ^ words[right][None, :, :]
            p, q = np.nonzero(np.bitwise_count(diff).sum(-1) <= radius)
            diff, p, q = diff[p, q], a[p], right[q]
            keep = p < q if i == j else np.ones(len(p), bool)
            for mask in masks:  # met in an earlier table
                keep &= ((diff & mask) != 0).any(1)
            p, q = p[keep], q[keep]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            linked.append((p, q))
        root = roots(*(np.concatenate([x[k] for x in linked]) for k in (0, 1)), len(cid))
        seen = links > 0
        return pa.table({"cid": cid[seen], "links": links[seen], "root": cid[root[seen]]})

    links = stage(units.groupBy("t", "key", "i", "j").applyInArrow(compare, "cid long, links long, root long"), "simhash-links")
    found = links.groupBy("cid").agg(F.sum("links").alias("links"))
    nodes = components(links.where("cid != root"), "cid", "root", "simhash-groups")
    rep = classes.select("cid", "rep")
    named = nodes.join(rep, nodes["node"] == rep["cid"]).groupBy("component").agg(F.min("rep").alias("name"))
    named = nodes.join(named, "component").select(F.col("node").alias("cid"), "name")
    key = fresh_name(rows, "print")
    per_class = (classes.join(found, "cid", "left").join(named, "cid", "left")
                 .select(F.col("p").alias(key), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_near"), F.coalesce("name", "rep").alias("_name")))
    out = rows.alias("r").join(per_class.alias("c"), print_ == F.col(f"c.{key}"), "left")
    return out.select("r.*", F.coalesce("c.n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce(F.col("c._name"), id_).alias("component_id"))


def _mask(chosen: list[slice]) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    for s in chosen:
        bits[s] = 1
    return np.packbits(bits).tobytes()
