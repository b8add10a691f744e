"""Fill-in-middle: texts cut at two token boundaries, their middle moved behind prefix and suffix."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boundary_set import BoundarySet
from .common import by_block, fresh_name
from .hashing import BLANKS

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that are cut, and of the cut ones that begin with their suffix.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
ADDED = {"_fim": "string", "_form": "string", "_n_units": "long", "_prefix_chars": "long", "_middle_chars": "long"}


def unit_ends(data: np.ndarray, at: np.ndarray, unit: str) -> np.ndarray:
    """Offsets behind each unit of the texts ``data[at[k]:at[k + 1]]``: tokens (blanks and the word after them, or the blanks
    that end a text) or characters."""
    stop = np.ones(len(data), bool)
    if unit == "token":
        word = ~BLANKS[data]
        stop[:-1] = word[:-1] & ~word[1:]
    else:
        stop[:-1] = (data[1:] & 0xC0) != 0x80
    stop[at[1:][at[:-1] < at[1:]] - 1] = True
    return np.flatnonzero(stop) + 1


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED,
              unit: str = "token") -> DataFrame:
    """``docs`` plus ``_fim`` (the text as it is, or its three parts behind their marks), ``_form`` (plain, psm or spm), ``_n_units``,
    ``_prefix_chars`` and ``_middle_chars`` (code points; null if plain). ``restore`` gives the text back.

    A text has n units: tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, or characters. Four numbers h1 to h4 are the
    first 8-digit groups of the hex sha256 of ``seed:doc_id``. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the
    middle after the larger. A text is plain if it is empty or holds a mark, or if h3 % 100 >= rate; else it is spm (suffix
    first) if h4 % 100 < suffix_first, or psm.

    The ends of all units of a block of texts form one set of offsets in array, bitmap and run containers; the offset behind a
    text's u-th unit is found by rank. Nothing is shuffled; a task holds one block of texts at a time.

    Null and empty texts are empty and plain. A null id counts as the empty string; rows of one id and
    text are cut alike. Other columns are kept, ones named like the added are replaced; an empty table gives no rows.
    """
    docs = docs.drop(*ADDED)
    key = fresh_name(docs, "key")
    old = docs.columns
    keyed = docs.withColumn(key, F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def block(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.Table:
        ends = unit_ends(data, at, unit)
        first = np.searchsorted(ends, at, side="right")
        n = np.diff(first)
        digest = [hashlib.sha256(f"{seed}:{k}".encode()).digest()[:16] for k in rows.column(key).to_pylist()]
        h = np.frombuffer(b"".join(digest), ">u4").reshape(-1, 4).astype(np.int64)
        cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
        found = np.repeat(at[:-1], 2)  # a part of no units ends where the text begins
        some = np.flatnonzero(cuts.ravel())
        found[some] = BoundarySet(ends).select((first[:-1, None] + cuts - 1).ravel()[some])
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        raw, out, form = data.tobytes(), [], []
        for a, x, y, b, (h3, h4) in zip(at[:-1], found[::2], found[1::2], at[1:], h[:, 2:], strict=True):
            whole = raw[a:b]
            if a == b or h3 % 100 >= rate or any(m in whole for m in marks):
                out.append(whole)
                form.append("plain")
                continue
            before, behind = (marks[0], raw[a:x]), (marks[1], raw[y:b])
            form.append("spm" if h4 % 100 < suffix_first else "psm")
            out.append(b"".join([*(behind + before if form[-1] == "spm" else before + behind), marks[2], raw[x:y]]))
        plain = np.array(form) == "plain"
        return pa.table({**{c: rows.column(c) for c in old}, "_fim": pa.array(out, pa.binary()).cast(pa.string()), "_form": form, "_n_units": n,
                         "_prefix_chars": pa.array(chars[found[::2]] - chars[at[:-1]], mask=plain),
                         "_middle_chars": pa.array(chars[found[1::2]] - chars[found[::2]], mask=plain)})

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in old), *(f"{c} {t}" for c, t in ADDED.items())])
    return by_block(keyed, schema, block, text)


def restore(fim: Column, form: Column) -> Column:
    """The exact text of a transformed one: texts that hold a mark are never cut, so the marks found are those set."""
    parts = F.split(fim, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(fim)
