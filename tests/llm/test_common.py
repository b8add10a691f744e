import random

import numpy as np
import pyarrow as pa

from staylens.llm import common as C


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert C.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_roots():
    assert C.roots(np.array([4, 2, 5]), np.array([2, 1, 3]), 7).tolist() == [0, 1, 1, 3, 1, 3, 6]


def test_byte_blocks():
    text = pa.array(["é", None, "", "abc" * 10, "x"])
    for most in (1, 8, 100):
        got = [(lo, hi, bytes(data), at.tolist()) for lo, hi, data, at in C.byte_blocks(text.slice(1), most)]
        assert b"".join(g[2] for g in got) == b"abc" * 10 + b"x" and got[0][0] == 0 and got[-1][1] == 4
    assert list(C.byte_blocks(pa.array([], pa.string()))) == []
