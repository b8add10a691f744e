"""Benchmark decontamination: an FM-index per shard of training text, backward search of benchmark windows.

A shard is a block of documents inside a task. Its text becomes a sequence of word numbers: words that no
benchmark item holds cannot take part in a match, so each run of them is one separator, and a document's end
is one too. The FM-index of that sequence holds the Burrows-Wheeler transform in a wavelet matrix (rank in
log2(words) steps) and every ``SAMPLE``-th suffix position; a separator's successor is always sampled, so
locating an occurrence never walks through a separator.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, by_block

WINDOW = 10
SAMPLE = 16
SHARD_BYTES = 8 << 20
#: Benchmark text sent to the tasks at once; a larger benchmark is searched in several passes.
ITEM_BYTES = 32 << 20
#: Windows searched at once.
PHRASES = 1 << 16


class WaveletMatrix:
    """Rank of a symbol and access to a position of a sequence of small integers, both for arrays of queries."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``at`` and their ranks before ``at``."""
        symbol, lo = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            a, b = ones[lo], ones[at]
            lo, at = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, at - b)
            symbol = symbol * 2 + bit
        return symbol, at - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; stops as soon as all ranks differ."""
    n, width = len(seq), 1
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """FM-index of symbols >= 1; 0 marks separators, of which the last position must hold one."""

    def __init__(self, seq: np.ndarray, sigma: int):
        n, sep = len(seq), seq == 0
        # every separator is a symbol of its own below all words, so comparisons end there
        order = suffix_array(np.where(sep, np.cumsum(sep) - 1, seq + sep.sum()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.tree = WaveletMatrix(seq[order - 1], sigma)
        kept = (np.arange(n) % SAMPLE == 0) | np.concatenate([[True], sep[:-1]])
        kept = kept[order]
        self.sampled, self.positions = np.concatenate([[0], np.cumsum(kept)]), order[kept]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases (rows of equal length): their numbers, first and end row, if they occur."""
        which = np.arange(len(phrases))
        c = phrases[:, -1]
        lo, hi = self.first[c], self.first[c + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
            c = phrases[which, k]
            lo, hi = self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)
        alive = lo < hi
        return which[alive], lo[alive], hi[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: LF steps until a sampled row."""
        out, todo, steps = np.empty_like(rows), np.arange(len(rows)), 0
        while len(todo):
            known = self.sampled[rows + 1] > self.sampled[rows]
            out[todo[known]] = self.positions[self.sampled[rows[known]]] + steps
            todo, rows = todo[~known], rows[~known]
            if len(todo):
                symbol, rank = self.tree.access(rows)
                rows, steps = self.first[symbol] + rank, steps + 1
        return out


class Windows:
    """The distinct windows of benchmark items as arrays: word numbers (from 1) of all items in a row, and by length the
    first place of each window and the items that hold it (numbers of ``names``; items with a null id have none)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        words, ends, owner = array("i"), [0], []
        for item, text in items:
            words.extend([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words((text or "").encode())])
            ends.append(len(words))
            owner.append(number.get(item, -1))
        self.words = np.array(words, np.int32)
        size, owner = np.diff(ends), np.array(owner, np.int32)
        count = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        item = np.repeat(np.arange(len(size)), count)
        start = np.array(ends[:-1], np.int64)[item] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(size, window)[item]
        self.by_length = {int(n): self._distinct(start[length == n], owner[item[length == n]], int(n)) for n in np.unique(length)}

    def _distinct(self, start: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place of each distinct window, ends of its items among the third, items)."""
        code = np.zeros(len(start), np.int64)
        for k in range(length):  # numbers of the prefixes of k words: exact, no hashing
            code = np.unique(code * (len(self.vocabulary) + 1) + self.words[start + k], return_inverse=True)[1]
        first = np.unique(code, return_index=True)[1]
        held = owner >= 0
        pairs = np.unique(code[held] * (len(self.names) + 1) + owner[held])
        at, owners = np.divmod(pairs, len(self.names) + 1)
        return start[first], np.cumsum(np.bincount(at, minlength=len(first))), owners.astype(np.int32)

    def phrases(self):
        """(words of windows of one length, a bounded number at a time; the number of items up to each, from the one before the first; items)."""
        for length, (start, ends, owners) in self.by_length.items():
            edge = np.concatenate([[0], ends])
            for lo in range(0, len(start), PHRASES):
                yield self.words[start[lo : lo + PHRASES, None] + np.arange(length)].astype(np.int64), edge[lo : lo + PHRASES + 1], owners


def search(wanted: Windows, docs: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
    """Word counts, merged hit spans (in words) and occurring items of each document of a shard."""
    get, ids, counts = wanted.vocabulary.get, [], np.zeros(len(docs), np.int64)
    for k, doc in enumerate(docs):
        words = alnum_words(doc)
        counts[k] = len(words)
        ids.extend([get(w, 0) for w in words])
        ids.append(0)
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    found: list[set] = [set() for _ in docs]
    whole = np.array(ids, np.int64)
    ends = np.cumsum(counts + 1)
    keep = (whole != 0) | np.concatenate([[False], whole[:-1] != 0])  # the first of each run of separators
    keep[-1] = True
    at = np.flatnonzero(keep)
    seq = whole[at]
    if not seq.any():
        return counts, spans, found
    index = FMIndex(seq, len(wanted.vocabulary) + 1)
    starts, stops = [], []
    for phrases, edge, owners in wanted.phrases():
        which, lo, hi = index.ranges(phrases)
        size = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        begin = at[index.locate(rows)]
        starts.append(begin)
        stops.append(begin + phrases.shape[1])
        doc = np.searchsorted(ends, begin, side="right")
        for d, w in np.unique(np.stack([doc, np.repeat(which, size)], 1), axis=0):
            found[d].update(wanted.names[k] for k in owners[edge[w] : edge[w + 1]])
    begin, stop = np.concatenate(starts), np.concatenate(stops)
    edge = np.bincount(begin, minlength=len(whole) + 1) - np.bincount(stop, minlength=len(whole) + 1)
    inside = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
    turn = np.flatnonzero(np.diff(inside))
    first = np.concatenate([[0], ends[:-1]])
    for a, b in turn.reshape(-1, 2):
        d = int(np.searchsorted(ends, a, side="right"))
        spans[d].append((int(a - first[d]), int(b - first[d])))
    return counts, spans, found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Benchmark hits of every document, without a shuffle: ``docs`` plus ``_n_words`` (words), ``_spans``
    (merged spans of hit words, [start, end) in words) and ``_items`` (ids, as sorted strings, of the items
    with an occurring window).

    A window is ``window`` consecutive words of an item; an item of fewer words, but some, is one window.
    The benchmark is read to the driver in parts of at most ``item_bytes`` of text (an item longer than that
    is a part of its own) and each part is searched in a pass of its own, so what is sent never grows with it.
    Null texts have no words; an item with a null id hits words but is not listed; repeated items count once;
    an empty benchmark hits nothing; other columns of ``docs`` are kept, ones named like the added columns are replaced.
    """
    items = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("x")).where("x is not null").distinct()
    total = items.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    parts = max(1, -(-total // item_bytes))
    added = "_n_words long, _spans array<struct<start:int,end:int>>, _items array<string>"
    out = docs
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("x"), F.lit(parts)) == part)
        out = _search_part(out, [tuple(r) for r in mine.collect()], window, text, added, part > 0)
    return out


def _search_part(docs: DataFrame, items: list, window: int, text: str, added: str, again: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Windows(items, window))
    old = [c for c in docs.columns if c not in ("_n_words", "_spans", "_items")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in old) + ", " + added

    def shard(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.Table:
        raw = data.tobytes()
        counts, spans, found = search(sent.value, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        if again:
            spans = [merge(s, [(x["start"], x["end"]) for x in o]) for s, o in zip(spans, rows.column("_spans").to_pylist(), strict=True)]
            found = [f | set(o) for f, o in zip(found, rows.column("_items").to_pylist(), strict=True)]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({**{c: rows.column(c) for c in old}, "_n_words": counts,
                         "_spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span),
                         "_items": pa.array([sorted(f) for f in found], pa.list_(pa.string()))})

    return by_block(docs, schema, shard, text, SHARD_BYTES)


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans; those that touch become one."""
    out: list[list[int]] = []
    for lo, hi in sorted([*a, *b]):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]
