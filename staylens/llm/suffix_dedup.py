"""Repeated byte strings: enhanced suffix arrays of anchored suffixes, their common-prefix interval trees, and
left-extension tests that give maximal repeats with all their occurrences.

Any string of LENGTH bytes holds an anchor: the least hash of its GRAM-byte strings, at a place that its bytes
alone decide. So equal strings have equal anchors, and only suffixes that begin at anchors need sorting: those
that begin with the same GRAM bytes form a bucket, a subtree of the suffix tree. A suffix's context is what a
string of LENGTH bytes around its anchor can cover: LENGTH - GRAM bytes before it and LENGTH bytes from it on.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, by_block, mix64, partitions, stage
from .hashing import prefix_sums

LENGTH = 200
GRAM = 64
#: Buckets of more contexts than this are divided by how much of a string lies before the anchor.
WIDE = 2048
#: Bytes of text whose hashes a task holds at once.
ANCHOR_BYTES = _SPAN = 1 << 20
_PLACE = 24


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, document, hash of the gram, hash of the context) of every anchor of the documents of a block."""
    places, hashes, contexts = [], [], []
    window, before = length - gram + 1, length - gram
    doc_end = np.repeat(at[1:], np.diff(at))
    doc_start = np.repeat(at[:-1], np.diff(at))
    for lo in range(0, len(data), _SPAN):
        first, stop = max(0, lo - before), min(len(data), lo + _SPAN + length + before)
        h, down = prefix_sums(data[first:stop])
        n = min(stop, lo + _SPAN + window - 1 + gram - 1) - lo - gram + 1  # grams from lo on
        if n < window:
            continue
        o = lo - first
        full = mix64((h[o + gram : o + gram + n] - h[o : o + n]) * down[o : o + n])
        inside = doc_end[lo : lo + n] - np.arange(lo, lo + n) >= gram
        place = np.arange(n, dtype=np.uint64)
        key = np.where(inside, full >> np.uint64(_PLACE), np.uint64((1 << 64 - _PLACE) - 1)) << np.uint64(_PLACE) | place
        # least key of each window: minima of blocks of its size, from both sides
        m = -(-n // window) * window
        padded = np.concatenate([key, np.full(m - n, np.uint64((1 << 64) - 1))]).reshape(-1, window)
        ahead = np.minimum.accumulate(padded, 1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
        whole = doc_end[lo : lo + n - window + 1] - np.arange(lo, lo + n - window + 1) >= length
        p = np.unique((least[whole] & np.uint64((1 << _PLACE) - 1)).astype(np.int64))
        a = np.maximum(p + lo - before, doc_start[p + lo])
        b = np.minimum(p + lo + length, doc_end[p + lo])
        context = mix64((h[b - first] - h[a - first]) * down[a - first]) ^ ((p + lo - a).astype(np.uint64) << np.uint64(32)) ^ (b - p - lo).astype(np.uint64)
        places.append(p + lo)
        hashes.append(full[p])
        contexts.append(mix64(context))
    if not places:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64), none, none
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.searchsorted(at, place, side="right") - 1, np.concatenate(hashes)[first], np.concatenate(contexts)[first]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The nodes (first, end, depth) of the common-prefix interval tree, children before parents: ``lcp[k]`` is that of the sorted
    suffixes k - 1 and k, ``lcp[0]`` is 0; nodes of a depth under ``least`` are left out."""
    stack = [(0, 0)]
    for k in range(1, len(lcp) + 1):
        depth, first = (lcp[k] if k < len(lcp) else 0), k - 1
        while stack[-1][0] > depth:
            top, first = stack.pop()
            if top >= least:
                yield first, k, top
        if stack[-1][0] < depth:
            stack.append((depth, first))


def repeats(suffixes: list[tuple[bytes, bytes]], length: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int]]]]:
    """Of a bucket's distinct contexts (reversed bytes before the anchor, bytes from it on): how far (before, behind) the anchor each
    is covered by strings of ``length`` bytes or more that another one shares, (0, 0) if by none; and its maximal
    repeats (before, behind, all members).

    The suffix array orders the contexts by the bytes from the anchor on; an interval of its tree is a common right
    extension. Its members, ordered by the bytes before the anchor, have a tree of common left extensions: a node
    of both, whose members don't all lie in one child interval (they are extended by different bytes on the right)
    nor agree on a byte more on the left, is a maximal repeat.
    """
    order = sorted(range(len(suffixes)), key=lambda k: suffixes[k][1])
    lcp = [0, *(common_prefix(suffixes[a][1], suffixes[b][1]) for a, b in zip(order[:-1], order[1:], strict=True))]
    cover, found = [(0, 0)] * len(suffixes), []
    child: list[int] = [-1] * len(suffixes)  # the last interval that held a member: a child of the next that does
    for number, (first, end, behind) in enumerate(intervals(lcp, 1)):
        members = sorted(order[first:end], key=lambda k: suffixes[k][0])
        left = [0, *(common_prefix(suffixes[a][0], suffixes[b][0]) for a, b in zip(members[:-1], members[1:], strict=True))]
        for k, m in enumerate(members):
            before = max(left[k], left[k + 1] if k + 1 < len(left) else 0)
            if before + behind >= length:
                cover[m] = max(cover[m][0], before), max(cover[m][1], behind)
        # a common extension of all members, 0 included, is the root of the left tree
        root = [(0, len(members), 0)] if len(left) > 1 and min(left[1:]) == 0 else []
        for lo, hi, before in [*intervals(left, 1), *root]:
            group = members[lo:hi]
            if before + behind >= length and (len({child[m] for m in group}) > 1 or child[group[0]] == -1):
                found.append((before, behind, group))
        for m in members:
            child[m] = number
    return cover, found


def _anchored(rows: DataFrame, id_type: str, length: int, gram: int) -> DataFrame:
    """(h, c, _id, _t, loc) of each anchor; loc holds the row's ``_u`` and the place."""

    def block(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.Table | None:
        place, doc, h, c = anchors(data, at, length, gram)
        if not len(place):
            return None
        loc = part.column("_u").to_numpy().astype(np.int64)[doc] << 32 | (place - at[doc])
        row = pa.array(doc)
        return pa.table({"h": h.view(np.int64), "c": c.view(np.int64), "_id": part.column("_id").take(row), "_t": part.column("_t").take(row), "loc": loc})

    return by_block(rows, f"h long, c long, _id {id_type}, _t long, loc long", block, "_text", ANCHOR_BYTES)


#: What names a row: its id and 96 bits of hashes of its text (rows alike in both have the same spans).
_ROW = ["_id", "_t", "_u"]


def _named(text: str) -> tuple:
    return F.xxhash64(text).alias("_t"), F.hash(text).alias("_u")


def _same_row(a: str, b: str):
    return F.col(f"{a}._t").eqNullSafe(F.col(f"{b}._t")) & F.col(f"{a}._u").eqNullSafe(F.col(f"{b}._u")) & F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id"))


def repeat_occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, wide: int = WIDE,
                       groups: bool = False) -> DataFrame:
    """(_id, _t, _u, start, stop, and with ``groups`` group) of covered byte ranges, a row per anchor and range; they overlap.

    With ``groups``, a row is an occurrence of a maximal repeat as far as an anchor's context shows it: ``group`` names the repeat,
    and all its occurrences are there. In buckets of over ``wide`` contexts a repeat is shown as far as its range of the bucket shows it.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("_id"), *_named(text), F.col(text).alias("_text")).where(F.octet_length("_text") >= length)
    found = _anchored(rows, id_type, length, gram)
    before = length - gram
    shared = found.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("m > 1")
    shared = stage(shared.select("h", (F.col("c0") == F.col("c1")).alias("one")), "suffix-shared")  # staged: a hot h is then split in the join
    hits = stage(found.join(shared, "h"), "suffix-hits")
    text_hash = F.shiftright("loc", 32).cast("int").alias("_u")
    # contexts of buckets that hold several, each with its weight and one place
    several = hits.where("not one").groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_t", "loc")).alias("r"))
    several = stage(several.select("h", "c", "m", "r._id", "r._t", "r.loc").select("h", "c", "m", "_id", "_t", text_hash, F.col("loc").bitwiseAND(0xFFFFFFFF).alias("at")),
                    "suffix-contexts")
    wanted = several.groupBy(*_ROW).agg(F.collect_list(F.struct("h", "c", "m", "at")).alias("w"))
    texts = rows.alias("d").join(wanted.alias("w"), _same_row("d", "w")).select(F.col("d._text").alias("_text"), F.col("w.w").alias("w"))

    def cut(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.Table:
        raw = data.tobytes()
        h, c, m, left, right = [], [], [], [], []
        for k, wanted in enumerate(part.column("w").to_pylist()):
            for w in wanted:
                p = at[k] + w["at"]
                h.append(w["h"])
                c.append(w["c"])
                m.append(w["m"])
                left.append(raw[max(at[k], p - before) : p][::-1])
                right.append(raw[p : min(at[k + 1], p + length)])
        return pa.table({"h": pa.array(h, pa.int64()), "c": pa.array(c, pa.int64()), "m": pa.array(m, pa.int64()), "l": pa.array(left, pa.binary()), "r": pa.array(right, pa.binary())})

    contexts = by_block(texts, "h long, c long, m long, l binary, r binary", cut, "_text")
    sizes = several.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    contexts = stage(contexts.join(sizes.hint("merge"), "h").dropDuplicates(["h", "c"]), "suffix-cut")
    narrow = contexts.where(F.col("k") <= wide).select("h", F.col("h").alias("key"), "c", "m", "l", "r")
    covers = [stage(_trees(narrow, blocks_for(several.count() * 2 * length, 32 << 20), length, gram, groups), "suffix-covers").drop("key")]
    covers += _divided(contexts.where(F.col("k") > wide), length, gram, wide, groups)
    covers = functools.reduce(DataFrame.unionByName, covers)
    if not groups:
        covers = covers.groupBy("h", "c").agg(F.max("a").alias("a"), F.max("b").alias("b")).withColumn("group", F.lit(None).cast("long"))
        covers = stage(covers, "suffix-covered")  # a context that stands in many rows is then split in the join
    place = F.col("loc").bitwiseAND(0xFFFFFFFF)
    whole = hits.where("one").select("_id", "_t", text_hash, F.greatest(place - before, F.lit(0)).alias("start"), (place + length).alias("stop"), F.col("c").alias("group"))
    part = (hits.where("not one").join(covers.hint("merge"), ["h", "c"])
            .select("_id", "_t", text_hash, (place - F.col("a")).alias("start"), (place + F.col("b")).alias("stop"), "group"))
    return whole.union(part)


def _trees(members: DataFrame, buckets: int, length: int, gram: int, groups: bool) -> DataFrame:
    """(h, key, c, group, a, b): how far before and behind the anchor each member (h, key, c, m, l, r) of a bucket (h, key) is covered;
    with ``groups`` a row for each maximal repeat it is in. Buckets meet in tasks by hash, whole."""
    schema = "h long, key long, c long, group long, a int, b int"

    def tree(group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("key").to_numpy(), group.column("h").to_numpy()))
        group = group.combine_chunks().take(pa.array(order))
        h, key, c, m = (group.column(x).to_numpy() for x in ("h", "key", "c", "m"))
        left, right = group.column("l").to_pylist(), group.column("r").to_pylist()
        out: list[tuple] = []
        cuts = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (key[1:] != key[:-1])) + 1, [len(h)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            cover, found = repeats(list(zip(left[lo:hi], right[lo:hi], strict=True)), length)
            if groups:
                for a, b, members in found:
                    s = members[0]
                    if (name := _name(left[lo + s][:a][::-1] + right[lo + s][:b], a, length, gram)) is not None:
                        out += [(h[lo], key[lo], c[lo + k], name, a, b) for k in members]
            for k in range(lo, hi):
                a, b = cover[k - lo]
                if m[k] > 1 and len(left[k]) + len(right[k]) >= length:  # the whole context occurs again
                    a, b = len(left[k]), len(right[k])
                    if groups and (name := _name(left[k][::-1] + right[k], a, length, gram)) is not None:
                        out.append((h[k], key[k], c[k], name, a, b))
                if a + b and not groups:
                    out.append((h[k], key[k], c[k], None, a, b))
        return pa.table({n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate(
            (("h", pa.int64()), ("key", pa.int64()), ("c", pa.int64()), ("group", pa.int64()), ("a", pa.int32()), ("b", pa.int32())))})

    n = max(partitions(members.sparkSession), buckets)
    return members.withColumn("bucket", F.pmod(F.xxhash64("h", "key"), F.lit(n))).groupBy("bucket").applyInArrow(tree, schema)


def halves(lo: int, hi: int) -> list[tuple[int, int]]:
    return [(lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)]


def _divided(contexts: DataFrame, length: int, gram: int, wide: int, groups: bool) -> list[DataFrame]:
    """Covers (h, c, group, a, b) of buckets of over ``wide`` contexts.

    A string of ``length`` bytes has n bytes before the anchor, 0 <= n <= length - gram. All strings with lo <= n <= hi share the lo bytes
    before the anchor and the length - hi from it on, so equal ones meet in the bucket of these bytes; and only hi bytes before and
    length - lo behind matter there, so contexts that agree on those are one class. The range of n is halved until a bucket has few
    classes, which then go through the tree; at the latest when lo = hi, where a bucket is one class. So each round makes two
    rows for a context of a bucket still wide, and every bucket is whole.
    """
    out: list[DataFrame] = []
    rows = contexts.select("h", "c", "m", "l", "r", F.lit(0).alias("lo"), F.lit(length - gram).alias("hi"))
    schema = "h long, c long, m long, lo int, hi int, key long, cls long, a int, b int"

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            got: list[list] = [[] for _ in names[3:]]
            who = []
            for k, (left, right, lo, hi) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("l", "r", "lo", "hi")), strict=True)):
                for a, b in halves(lo, hi):
                    if len(left) < a or len(right) < length - b:
                        continue
                    mine, to = left[:b], right[: length - a]
                    key, cls = (int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), signed=True)
                                for x in (left[:a] + right[: length - b], len(mine).to_bytes(4) + mine + to))
                    who.append(k)
                    for column, value in zip(got, (a, b, key, cls, len(mine), len(to)), strict=True):
                        column.append(value)
            take = pa.array(who, pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(batch.column(x).take(take) for x in names[:3]), *(pa.array(g, t) for g, t in zip(got, kinds, strict=True))], names)

    bucket = ["h", "lo", "hi", "key"]
    while not rows.isEmpty():
        parts = stage(rows.mapInArrow(halve, schema), "suffix-halves")
        classes = parts.groupBy(*bucket, "cls").agg(F.sum("m").alias("m"), F.min("c").alias("rep"), F.max("a").alias("a"), F.max("b").alias("b"))
        classes = stage(classes, "suffix-classes")
        sizes = stage(classes.groupBy(*bucket).agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("n")).where("n > 1"), "suffix-sizes")
        sized = stage(classes.join(sizes.where(F.col("k") <= wide), bucket), "suffix-few")
        # classes alone in their bucket share all of it; the others need the tree, on the bytes of one of their contexts
        alone = sized.where("k = 1 and a + b >= " + str(length)).select(*bucket, "cls", F.lit(None).cast("long").alias("group"), "a", "b")
        texts = contexts.select("h", F.col("c").alias("rep"), "l", "r")
        name = F.xxhash64("lo", "hi", "key")
        trees = (sized.where("k > 1").join(texts.hint("merge"), ["h", "rep"])
                 .select("h", name.alias("key"), F.col("cls").alias("c"), "m", F.expr("substring(l, 1, hi)").alias("l"), F.expr(f"substring(r, 1, {length} - lo)").alias("r")))
        trees = _trees(trees, 1, length, gram, groups).withColumnsRenamed({"c": "cls", "key": "name"})
        found = stage(alone.withColumn("name", name).select("h", "name", "cls", "group", "a", "b").unionByName(trees), "suffix-found")
        if groups:  # a class alone is a repeat of its own
            found = found.withColumn("group", F.coalesce("group", F.xxhash64("h", "cls")))
        out.append(parts.select("h", "c", "cls", name.alias("name")).join(found.hint("merge"), ["h", "name", "cls"]).select("h", "c", "group", "a", "b"))
        still = parts.join(sizes.where(F.col("k") > wide), bucket).select("h", "c", "lo", "hi")
        rows = contexts.select("h", "c", "m", "l", "r").join(stage(still, "suffix-open").hint("merge"), ["h", "c"])
    return out


def _name(text: bytes, at: int, length: int, gram: int) -> int | None:
    """The name of a repeat as its anchor at ``at`` shows it; None if that is no anchor of the repeat itself but of what surrounds it in
    some places (then not all occurrences have it, and the repeat's own anchors show them)."""
    if at not in anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), length, gram)[0]:
        return None
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), signed=True)


def with_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` plus ``_spans``: the places of ``repeat_occurrences`` in each row's text (null if none)."""
    found = repeat_occurrences(docs, doc_id, text, length)
    per_doc = found.groupBy(*_ROW).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))).alias("_spans"))
    named, hashed = F.col(f"d.`{text}`"), (F.xxhash64, F.hash)
    cond = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("s._id"))
    for column, f in zip(_ROW[1:], hashed, strict=True):
        cond &= f(named).eqNullSafe(F.col(f"s.{column}"))
    return docs.alias("d").join(per_doc.hint("merge").alias("s"), cond, "left").select("d.*", F.col("s._spans").alias("_spans"))


def cut_spans(raw: bytes, spans: list[dict] | None, whole_characters: bool) -> tuple[bytes, int, int]:
    """(the bytes outside the spans, bytes removed, maximal runs removed); a character is cut only if it is wholly covered, if asked."""
    merged: list[list[int]] = []
    for a, b in sorted((max(0, s["start"]), min(len(raw), s["stop"])) for s in spans or ()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        elif a < b:
            merged.append([a, b])
    if whole_characters:
        for s in merged:
            while s[0] < s[1] and raw[s[0]] & 0xC0 == 0x80:
                s[0] += 1
            while s[1] > s[0] and s[1] < len(raw) and raw[s[1]] & 0xC0 == 0x80:
                s[1] -= 1
        merged = [s for s in merged if s[0] < s[1]]
    kept, last = [], 0
    for a, b in merged:
        kept.append(raw[last:a])
        last = b
    kept.append(raw[last:])
    return b"".join(kept), sum(b - a for a, b in merged), len(merged)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, whole_characters: bool = True) -> DataFrame:
    """``docs`` with every byte cut from ``text`` that lies in a string of ``length`` bytes that also starts anywhere else, in the
    same document too; ``_n_bytes`` (of the whole text), ``_n_removed``, ``_n_spans`` and ``_sha256`` (of the bytes left) are added.

    All strings are judged on the input. Matches never cross documents. ``text`` keeps characters that are only partly covered
    if ``whole_characters``, else it and the digest are of the bytes left, and ``text`` is dropped, as it may not be UTF-8.
    Null texts are empty and stay null; repeated rows are documents of their own, so their texts repeat; other columns
    are kept, ones named like the added columns are replaced; an empty table gives no rows.
    """
    added = ("_n_bytes", "_n_removed", "_n_spans", "_sha256")
    docs = docs.drop(*added, "_spans")
    spans = with_spans(docs, doc_id, text, length)
    old = [c for c in docs.columns if c != text]

    def block(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.Table:
        raw = data.tobytes()
        got = [cut_spans(raw[a:b], s, whole_characters) for a, b, s in zip(at[:-1], at[1:], part.column("_spans").to_pylist(), strict=True)]
        valid = part.column(text).is_valid().to_pylist()
        out = {c: part.column(c) for c in old}
        if whole_characters:
            out[text] = pa.array([g[0].decode() if v else None for g, v in zip(got, valid, strict=True)], pa.string())
        return pa.table({**out, "_n_bytes": np.diff(at), "_n_removed": np.array([g[1] for g in got], np.int64), "_n_spans": np.array([g[2] for g in got], np.int64),
                         "_sha256": pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())})

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in old + [text] * whole_characters)
    return by_block(spans, schema + ", _n_bytes long, _n_removed long, _n_spans long, _sha256 string", block, text)
