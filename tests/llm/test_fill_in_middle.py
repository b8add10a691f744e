import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.llm import fill_in_middle as M
from staylens.llm.boundary_set import Bitmap, BoundarySet, Runs, Sorted

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, unit="token", rate=50, suffix_first=80):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, text, "plain", len(units), None, None
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < suffix_first else "psm"
    return doc_id, (f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"), form, len(units), len(pre), len(mid)


@pytest.mark.parametrize(("unit", "rate"), [("token", 50), ("token", 100), ("char", 100)])
def test_equals_brute_force_and_restores(spark, corpus, corpus_df, unit, rate):
    marked = [(2000, "a <P> b"), (2001, "<M>"), (2002, " \t"), (2003, "a b "), (2004, "x" * 70_000), (2005, "< P> <S <"), (2006, "é ü " * 40_000)]
    docs = corpus_df.union(spark.createDataFrame(marked, "doc_id long, text string"))
    made = M.transform(docs, unit=unit, rate=rate).withColumn("back", M.restore(F.col("_fim"), F.col("_form"))).collect()
    want = [plain(i, t, unit, rate) for i, t in corpus + marked]
    assert sorted(((r.doc_id, r._fim, r._form, r._n_units, r._prefix_chars, r._middle_chars) for r in made), key=str) == sorted(want, key=str)
    assert all(r.back == (r.text or "") for r in made)
    assert {r._form for r in made} == {"plain", "psm", "spm"}


def test_containers_select_what_sorted_offsets_hold():
    rng = np.random.default_rng(4)
    parts = [np.arange(5, 60_000), np.sort(rng.choice(65_536, 9000, replace=False)) + (1 << 16), np.sort(rng.choice(65_536, 300, replace=False)) + (7 << 16),
             np.arange(8 << 16, 10 << 16), np.array([(1 << 40) + 3])]
    offsets = np.concatenate(parts)
    made = BoundarySet(offsets)
    assert [type(c) for c in made.containers] == [Runs, Bitmap, Sorted, Runs, Runs, Sorted]
    rank = rng.permutation(len(offsets))
    assert len(made) == len(offsets) and (made.select(rank) == offsets[rank]).all()
    assert len(BoundarySet(offsets[:0])) == 0 and len(BoundarySet(offsets[:0]).select(np.zeros(0, np.int64))) == 0


def test_long_text_uses_bitmaps():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(40_000)).encode()
    data = np.frombuffer(text, np.uint8)
    ends = M.unit_ends(data, np.array([0, len(data)]), "token")
    made = BoundarySet(ends)
    assert any(isinstance(c, Bitmap) for c in made.containers) and (made.select(np.arange(len(ends))) == ends).all()


def test_empty_clashing_and_repeated(spark):
    assert M.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(1, "a b c", 7, "k", "K")] * 2, "doc_id int, text string, _form int, key string, _Key string")
    got = M.transform(rows, rate=100).collect()
    assert got[0] == got[1] and got[0].key == "k" and got[0]._Key == "K" and got[0]._form in ("psm", "spm")
