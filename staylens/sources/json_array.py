"""Large JSON arrays read in parallel: a file is split at any byte, and the scanner's state is carried from split to split.

Files are read as pieces between commas, which Spark splits like lines. Whether a piece begins inside a string, and how deep in
brackets, depends on all text before it: a first pass gives each split's effect for both cases (inside a string or not), the
effects of a file's splits are chained, and a second pass, which knows each split's start, cuts the array's elements. An element that
goes over the end of a split is put together from its parts. The marks of a batch of pieces are found by numpy in one go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import show_code

_MARKS = re.compile(r'["\\{}\[\]]')


def effect(piece: str, inside: bool, depth: int) -> tuple[bool, int]:
    """(inside a string, depth in brackets) behind a piece that begins in this state; an escaped character is passed over."""
    skip = -1
    for m in _MARKS.finditer(piece):
        at, c = m.start(), m.group()
        if at == skip:
            continue
        if c == "\\":
            skip = at + 1 if inside else -1
        elif c == '"':
            inside = not inside
        elif not inside:
            depth += 1 if c in "{[" else -1
    return inside, depth


#: What a byte may be to the scanner; all else is passed over.
_QUOTE, _OPEN, _CLOSE, _SLASH, _COMMA = 1, 2, 3, 4, 5
_KINDS = np.zeros(256, np.uint8)
for _c, _k in ((b'"', _QUOTE), (b"{", _OPEN), (b"[", _OPEN), (b"}", _CLOSE), (b"]", _CLOSE), (b"\\", _SLASH), (b",", _COMMA)):
    _KINDS[ord(_c)] = _k


@dataclass
class Marks:
    """The marks of a text: where they stand, their kind, whether inside a string, and the depth behind each."""

    at: np.ndarray
    kind: np.ndarray
    inside: np.ndarray
    depth: np.ndarray


def marks(text: bytes, inside: bool, depth: int) -> Marks:
    """All quotes, brackets and commas of a text that begins in this state, as ``effect`` reads them."""
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_KINDS[data])
    kind = _KINDS[data[at]]
    quote = kind == _QUOTE
    slashes = at[kind == _SLASH]
    if len(slashes):
        first = np.concatenate([[True], np.diff(slashes) > 1])
        runs = slashes[first]
        lengths = np.diff(np.append(np.flatnonzero(first), len(slashes)))
        quote &= ~np.isin(at, (runs + lengths)[lengths % 2 == 1])  # an odd run of backslashes escapes what follows
        within = (inside + np.cumsum(quote)) % 2 == 1
        if not within[np.searchsorted(at, runs)].all():  # a backslash outside of strings escapes nothing: read mark by mark
            quote = _quotes(at, kind, inside)
    within = (inside + np.cumsum(quote)) % 2 == 1
    rise = np.where(within, 0, (kind == _OPEN).astype(np.int64) - (kind == _CLOSE))
    return Marks(at, kind, within, depth + np.cumsum(rise))


def _quotes(at: np.ndarray, kind: np.ndarray, inside: bool) -> np.ndarray:
    """Which marks are quotes that begin or end a string."""
    out, skip = np.zeros(len(at), bool), -1
    some = np.flatnonzero((kind == _QUOTE) | (kind == _SLASH))
    for k, p, c in zip(some.tolist(), at[some].tolist(), kind[some].tolist(), strict=True):
        if p == skip:
            continue
        if c == _SLASH:
            skip = p + 1 if inside else -1
        else:
            out[k], inside = True, not inside
    return out


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the pieces between commas; a file is named by 64 bits of its path."""
    text = spark.read.option("lineSep", ",").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(file, block, text): pieces of one split as one text, a comma behind each."""
    for batch in batches:
        if not len(batch):
            continue
        file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
        ends = [*(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(batch)]
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            values = batch.column("value").slice(a, b - a)
            yield int(file[a]), int(block[a]), pc.binary_join(pa.ListArray.from_arrays([0, b - a], values), ",")[0].as_buffer().to_pybytes() + b","


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: its first character that isn't blank, and where each of the two starts ends."""
    out: list[dict] = []
    for file, block, text in _runs(batches):
        if not out or (file, block) != (out[-1]["file"], out[-1]["block"]):
            out.append({"file": file, "block": block, "lead": "", "ends": [False, True], "rises": [0, 0]})
        r = out[-1]
        found = [marks(text, e, d) for e, d in zip(r["ends"], r["rises"], strict=True)]
        r["ends"], r["rises"] = [bool(m.inside[-1]) for m in found], [int(m.depth[-1]) for m in found]
        if not r["lead"]:
            r["lead"] = next((x[0] for x in (piece.lstrip() for piece in text.decode().split(",")) if x), "")
    if out:
        yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.int64()), ("block", pa.int64()), ("lead", pa.string()),
                                                         ("ends", pa.list_(pa.bool_())), ("rises", pa.list_(pa.int64()))]))


def _starts(effects: list) -> dict[tuple[int, int], tuple[bool, int, bool, bool]]:
    """(inside, depth, whether the file is an array, whether it begins here) at the start of each split, by chaining a file's splits."""
    out, file, inside, depth, array = {}, None, False, 0, False
    for r in sorted(effects, key=lambda r: (r["file"], r["block"])):
        begins = r["file"] != file
        if begins:
            file, inside, depth, array = r["file"], False, 0, r["lead"] == "["
        out[file, r["block"]] = inside, depth, array, begins
        inside, depth = r["ends"][inside], depth + r["rises"][inside]
    return out


#: Parts of an element: the last of those a split begins, one that fills a split, and the end of one begun before.
_TAIL, _THROUGH, _HEAD = 2, 1, 0


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of each element of the JSON array in each file; a file that is no array is one value. Elements are not
    parsed: one that is no JSON comes as it is, as does the rest of a file that ends too early. Only blanks may follow an array.

    A row per split comes to the driver and goes to the tasks; a file is never whole in one task (but one without commas,
    and each single element).
    """
    show_code(spark)
    pieces = _pieces(spark, path)
    found = pieces.mapInArrow(_effects, "file long, block long, lead string, ends array<boolean>, rises array<long>").collect()
    sent = spark.sparkContext.broadcast(_starts(found))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, parts, cuts, over, begins = None, [], 0, False, False
        inside, depth, array = False, 0, False

        def element() -> None:
            text = b"".join(parts)
            rows.append((None, None, None, text) if cuts or begins else (*key, _HEAD, text))

        def leave() -> None:
            if key is not None and not over:
                rows.append((*key, _TAIL if cuts or begins else _THROUGH, b"".join(parts)[:-1] if parts else None))

        for file, block, text in _runs(batches):
            if (file, block) != key:
                leave()
                key, parts, cuts = (file, block), [], 0
                inside, depth, array, begins = sent.value[key]
                over = array and depth <= 0 and not begins
            if over:
                continue
            if array and depth == 0:  # the file's first piece
                head, rest = text.split(b",", 1)
                text, depth = head.decode().lstrip()[1:].encode() + b"," + rest, 1
            m = marks(text, inside, depth)
            inside, depth = bool(m.inside[-1]), int(m.depth[-1])
            begun = 0  # where the rest of an element begins in this text
            if array:
                free = (m.kind == _COMMA) & ~m.inside
                done = np.flatnonzero(free & (m.depth <= 0))  # the array ends in the piece before the first such comma
                at = m.at[free & (m.depth == 1)]
                if len(done):
                    end = int(m.at[done[0]])
                    at = at[at < end]
                for p in at.tolist():
                    parts.append(text[begun:p])
                    element()
                    parts, cuts, begun = [], cuts + 1, p + 1
                if len(done):
                    piece = text.rfind(b",", 0, end) + 1
                    closed = m.at[(m.at >= piece) & (m.at < end) & (m.kind == _CLOSE) & ~m.inside & (m.depth == 0)]
                    closed = [p for p in closed.tolist() if text[p] == 0x5D]
                    parts.append(text[begun : closed[0] if closed else end])
                    element()
                    parts, cuts, over = [], cuts + 1, True
                    begun = len(text)
            if begun < len(text):
                parts.append(text[begun:])
            if len(rows) >= 2048:
                yield _batch(rows)
                rows.clear()
        leave()
        if rows:
            yield _batch(rows)

    made = pieces.mapInArrow(cut, "file long, block long, part int, value string")
    whole = made.where("file is null").select("value")
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = made.where("file is not null").withColumn("owner", F.last(F.when(F.col("part") == _TAIL, F.col("block")), ignorenulls=True).over(order))
    joined = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "part", "value"))).alias("p"))
    return whole.union(joined.select(F.array_join("p.value", ",").alias("value"))).where(F.trim("value") != "")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays[:3], arrays[3].cast(pa.string())], ["file", "block", "part", "value"])
