"""Vectorised 64-bit hashes of words and byte windows inside blocks of documents."""

from __future__ import annotations

import functools

import numpy as np

from .common import mix64

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True


@functools.cache
def _letters(lower: bool) -> np.ndarray:
    """A random odd value for each byte; A-Z as a-z if ``lower``."""
    value = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    if lower:
        value[65:91] = value[97:123]
    return value


class _Powers:
    """Powers of the base and of its inverse modulo 2**64; no more than KEPT of each stay in the worker's memory."""

    KEPT = (1 << 20) + 4096

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.up, self.down
        if len(up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, f, np.uint64)])) for f in (_BASE, inverse))
            if n <= self.KEPT:
                self.up, self.down = up, down
        return up[:n], down[:n]


_powers = _Powers()


def prefix_sums(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(h, down): the hash of ``data[a:b]`` is ``mix64((h[b] - h[a]) * down[a])``, wherever it stands."""
    up, down = _powers(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters(lower)[data] * up[:-1])]), down


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word ``[^\\x20\\x09-\\x0D]+`` of the documents ``data[at[k]:at[k + 1]]``, with A-Z as a-z."""
    text = ~BLANKS[data]
    start, end = text.copy(), text.copy()
    full = at[:-1] < at[1:]
    begins, stops = at[:-1][full], at[1:][full] - 1
    start[1:] &= ~text[:-1]
    start[begins] = text[begins]
    end[:-1] &= ~text[1:]
    end[stops] = text[stops]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    h, down = prefix_sums(data, lower=True)
    return mix64((h[end] - h[start]) * down[start]), np.searchsorted(at, start, side="right") - 1


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct runs of ``words`` words, sorted by both; a document of fewer
    words, but some, has its whole sequence as one."""
    hashes, doc = word_hashes(data, at)
    n = len(hashes)
    count = np.bincount(doc, minlength=len(at) - 1)
    step = [np.uint64(pow(_STEP, k, 1 << 64)) for k in range(words)]
    total = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        total += hashes[k : k + len(total)] * step[k]
    whole = doc[: len(total)] == doc[words - 1 :] if len(total) else np.zeros(0, bool)
    few = np.flatnonzero((count > 0) & (count < words))
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.zeros(len(few), np.uint64)
    for k in range(words - 1):
        has = count[few] > k
        short[has] += hashes[first[few[has]] + k] * step[k]
    hashed = np.concatenate([mix64(total[whole]), mix64(short + count[few].astype(np.uint64))])
    doc = np.concatenate([doc[: len(total)][whole], few])
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    return doc[new], hashed[new]
