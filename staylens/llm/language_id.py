"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_block, mix64

#: n-grams kept in a profile, and ranked of a document.
PROFILE = 300
UNKNOWN = "und"
_GRAM_BITS = 40
_STEP = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) of all 1- to 3-grams of the lower-cased texts, sorted by the first two.

    Everything but letters is a blank; an n-gram may begin or end with the blank around a word, but holds none
    inside. An n-gram is a 40-bit hash of its code points. Long texts are counted in steps of positions.
    """
    texts = [t.lower() for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    cp = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), size)
    doc = np.append(doc, len(texts) - 1)
    is_letter = _letters()[cp]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]  # one blank after each word
    cp, doc, is_letter = np.where(is_letter, cp, 0)[keep].astype(np.uint64), doc[keep], is_letter[keep]
    # a blank stands with the word that follows or, at the end of a text, before it: grams take their letter's text
    keys, counts = [], []
    for lo in range(0, len(cp), _STEP):
        a, d, x = (v[lo : lo + _STEP + 2] for v in (cp, doc, is_letter))
        n = min(_STEP, len(cp) - lo)
        grams = [(a[:n][x[:n]], d[:n][x[:n]])]
        if len(a) > 1:
            m = min(n, len(a) - 1)
            grams.append(((a[:m] << np.uint64(21) | a[1 : m + 1]) + np.uint64(1 << 62), np.where(x[:m], d[:m], d[1 : m + 1])))
        if len(a) > 2:
            m = min(n, len(a) - 2)
            mid = x[1 : m + 1]
            grams.append((((a[:m] << np.uint64(21) | a[1 : m + 1]) << np.uint64(21) | a[2 : m + 2])[mid] + np.uint64(1 << 63), d[1 : m + 1][mid]))
        key = np.concatenate([mix64(g) >> np.uint64(64 - _GRAM_BITS) | at.astype(np.uint64) << np.uint64(_GRAM_BITS) for g, at in grams])
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        keys.append(key[first])
        counts.append(np.diff(np.append(first, len(key))))
    key, count = np.concatenate(keys), np.concatenate(counts)
    if len(keys) > 1:
        key, where = np.unique(key, return_inverse=True)
        count = np.bincount(where, count).astype(np.int64)
    return (key >> np.uint64(_GRAM_BITS)).astype(np.int64), (key & np.uint64((1 << _GRAM_BITS) - 1)).astype(np.int64), count


def fit_profiles(labelled: DataFrame, label: str, text: str = "text", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the ``size`` most frequent n-grams of all texts of each label, ranks from 0, ties by
    n-gram. Rows with a null label are ignored, null texts are empty. Each task sums its n-grams by label, so a
    label that holds most rows sends a row per n-gram and block."""

    def block(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.Table:
        raw = data.tobytes()
        doc, gram, count = gram_counts([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)])
        names, of = np.unique(np.array(rows.column("_label").to_pylist(), object), return_inverse=True)
        key, where = np.unique(of[doc].astype(np.int64) << _GRAM_BITS | gram, return_inverse=True)
        return pa.table({"lang": pa.array(names[key >> _GRAM_BITS], pa.string()), "gram": key & ((1 << _GRAM_BITS) - 1),
                         "n": np.bincount(where, count, len(key)).astype(np.int64)})

    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_label"), F.col(text).alias("_text"))
    counts = by_block(rows, "lang string, gram long, n long", block, "_text").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the bare row number lets the tasks keep only their best rows of a language before the shuffle
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("rank"))


def distances(texts: list[str], grams: np.ndarray, ranks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance of each text to each language (columns of ``ranks``), and n-grams ranked per text."""
    doc, gram, count = gram_counts(texts)
    order = np.lexsort((gram, -count, doc))
    doc, gram = doc[order], gram[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    top = place < size
    doc, gram, place = doc[top], gram[top], place[top]
    at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
    known = grams[at] == gram
    out = np.empty((len(texts), ranks.shape[1]))
    for k in range(ranks.shape[1]):
        away = np.where(known & (ranks[at, k] < size), np.abs(ranks[at, k] - place), size)
        out[:, k] = np.bincount(doc, away, len(texts))
    return out, np.bincount(doc, minlength=len(texts))


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` plus ``_lang`` (the label whose profile is nearest; ties: the first by code point) and ``_score``
    (1 less the distance as a part of the largest possible one). One pass, no shuffle.

    The profiles come to the driver: ``size`` rows a language. Whole texts are ranked. A null text, a text
    without letters, and every text if there are no profiles are ``und`` with score 0. Other columns are kept,
    ones named like the added columns are replaced.
    """
    rows = profiles.collect()
    langs = sorted({r.lang for r in rows})
    grams = np.array(sorted({r.gram for r in rows}), np.int64)
    ranks = np.full((len(grams), len(langs)), size, np.int64)
    for r in rows:
        ranks[np.searchsorted(grams, r.gram), langs.index(r.lang)] = r.rank
    sent = docs.sparkSession.sparkContext.broadcast((langs, grams, ranks))
    old = [c for c in docs.columns if c not in ("_lang", "_score")]

    def block(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.Table:
        langs, grams, ranks = sent.value
        raw = data.tobytes()
        lang, score = np.full(len(rows), UNKNOWN, object), np.zeros(len(rows))
        if langs:
            away, n = distances([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)], grams, ranks, size)
            best = away.argmin(1)
            has = n > 0
            lang[has] = np.array(langs, object)[best[has]]
            score[has] = 1 - away[has, best[has]] / (n[has] * size)
        return pa.table({**{c: rows.column(c) for c in old}, "_lang": pa.array(lang, pa.string()), "_score": score})

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in old) + ", _lang string, _score double"
    return by_block(docs, schema, block, text)
