"""A compressed ordered set of text offsets: containers of 2**16 offsets held as arrays, bitmaps or runs, and select by rank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Offsets of a container share all bits but the low 16; a bitmap of them takes 8,192 bytes, an array two bytes an offset.
LOW_BITS = 16
MOST_IN_ARRAY = 4096


@dataclass
class Sorted:
    """Few offsets, as they are."""

    low: np.ndarray

    @property
    def size(self) -> int:
        return len(self.low)

    def select(self, rank: np.ndarray) -> np.ndarray:
        return self.low[rank].astype(np.int64)


@dataclass
class Bitmap:
    """Many scattered offsets: 1,024 words of 64 bits, and how many bits stand before each word."""

    words: np.ndarray
    before: np.ndarray

    @property
    def size(self) -> int:
        return int(self.before[-1] + np.bitwise_count(self.words[-1]))

    def select(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, rank, side="right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = (bits.cumsum(1) > (rank - self.before[word])[:, None]).argmax(1)
        return word * 64 + inside


@dataclass
class Runs:
    """Long runs of offsets that follow each other: the first of each, and how many offsets stand before it."""

    first: np.ndarray
    before: np.ndarray
    size: int

    def select(self, rank: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, rank, side="right") - 1
        return self.first[run].astype(np.int64) + rank - self.before[run]


def container(low: np.ndarray) -> Sorted | Bitmap | Runs:
    """The smallest form of rising 16-bit offsets."""
    begins = np.concatenate([[0], np.flatnonzero(np.diff(low.astype(np.int64)) != 1) + 1])
    if 4 * len(begins) < min(2 * len(low), 1 << LOW_BITS - 3):
        return Runs(low[begins], begins, len(low))
    if len(low) <= MOST_IN_ARRAY:
        return Sorted(low)
    bits = np.zeros(1 << LOW_BITS, np.uint8)
    bits[low] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    count = np.cumsum(np.bitwise_count(words).astype(np.int64))
    return Bitmap(words, np.concatenate([[0], count[:-1]]))


class BoundarySet:
    """Rising offsets, found again by rank: a search in the containers' cumulative sizes, then a select in one container."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> LOW_BITS
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(high)) + 1, [len(offsets)]]) if len(offsets) else np.zeros(1, np.int64)
        self.high = high[cuts[:-1]]
        low = (offsets & (1 << LOW_BITS) - 1).astype(np.uint16)
        self.containers = [container(low[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.before = np.concatenate([[0], np.cumsum([c.size for c in self.containers], dtype=np.int64)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The offsets of the given ranks (0 is the least), each below the set's size."""
        at = np.searchsorted(self.before, rank, side="right") - 1
        out = np.zeros(len(rank), np.int64)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(len(self.containers) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[k] : cuts[k + 1]]
            out[mine] = (int(self.high[k]) << LOW_BITS) + self.containers[k].select(rank[mine] - self.before[k])
        return out
