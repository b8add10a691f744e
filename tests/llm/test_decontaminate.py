import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from staylens.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    """Brute force: (words, hit words, occurring items) of each document."""
    wanted = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wanted[tuple(w[k : k + window])].update([] if item is None else [str(item)])
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wanted:
                    hit |= set(range(k, k + n))
                    found |= wanted[x]
        out.append((i is None, i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(docs, items, **more):
    rows = D.decontaminate(docs, items, **more).collect()
    return sorted(((r.doc_id is None, r.doc_id, r._n_words, sum(s.end - s.start for s in r._spans), r._items) for r in rows), key=str)


@pytest.fixture(scope="module")
def items(corpus):
    texts = dict(corpus)
    rng = random.Random(8)
    some = [(k, " ".join(texts[k].split()[:14])) for k in range(0, 12)]
    return [*some, (some[1][0], some[1][1]), (50, texts[44][30:200]), (None, texts[45][:150]), (51, "ab, AB!"), (52, "\x01ab"), (53, ""), (54, None), (55, "..."),
            (56, " ".join(rng.choice(["ab", "ba"]) for _ in range(12))), (57, "ñandú 東京"), (58, "x" * 3000)]


def test_equals_brute_force(spark, corpus, corpus_df, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = plain(corpus, items)
    assert got(corpus_df, frame) == want
    assert sum(w[3] > 0 for w in want) > 12
    assert got(corpus_df, frame, item_bytes=300) == want  # several passes


def test_index_finds_all(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(60):
        seq = rng.integers(0, 4, rng.integers(2, 80))
        seq[-1] = 0
        seq[:-1][rng.random(len(seq) - 1) < 0.2] = 0
        index = D.FMIndex(seq, 5)
        for n in (1, 2, 3):
            phrases = np.array(np.meshgrid(*[[1, 2, 3, 4]] * n)).reshape(n, -1).T
            which, lo, hi = index.ranges(phrases)
            found = {(int(w), int(p)) for w, a, b in zip(which, lo, hi, strict=True) for p in index.locate(np.arange(a, b))}
            assert found == {(w, k) for w, p in enumerate(phrases) for k in range(len(seq) - n + 1) if (seq[k : k + n] == p).all()}


def test_windows_are_arrays():
    """Distinct windows with their items, however many are searched at once, in some 40 bytes a word."""
    rng = random.Random(3)
    items = [(str(k % 90), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for k in range(200)] + [(None, "a b c"), ("x", None)]
    wanted = D.Windows(items, 4)
    texts = {v: k for k, v in wanted.vocabulary.items()}
    got = {}
    for phrases, edge, owners in wanted.phrases():
        for k, p in enumerate(phrases):
            got[tuple(texts[c].decode() for c in p)] = {wanted.names[i] for i in owners[edge[k] : edge[k + 1]]}
    want = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 3) if w else 0):
            want[tuple(w[k : k + 4])].update([] if item is None else [item])
    assert got == dict(want)
    size = wanted.words.nbytes + sum(a.nbytes for x in wanted.by_length.values() for a in x)
    assert size < 40 * len(wanted.words)


def test_windows_searched_in_runs(spark, corpus, corpus_df, items, monkeypatch):
    want = plain(corpus, items)
    data = [(t or "").encode() for _, t in corpus]
    whole = D.search(D.Windows([(None if i is None else str(i), t) for i, t in items], 10), data)
    monkeypatch.setattr(D, "PHRASES", 7)
    parts = D.search(D.Windows([(None if i is None else str(i), t) for i, t in items], 10), data)
    assert whole[1] == parts[1] and whole[2] == parts[2]
    assert sorted(map(len, parts[2])) == sorted(len(w[4]) for w in want)


def test_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, _spans int, item_id string"
    one = spark.createDataFrame([(1, "a b", 3, "z")], schema)
    none = spark.createDataFrame([], "item_id long, text string")
    row = D.decontaminate(one, none).collect()[0]
    assert (row._n_words, row._spans, row._items, row.item_id) == (2, [], [], "z")
    assert D.decontaminate(spark.createDataFrame([], schema), none).collect() == []


def test_query(spark, sf_small):
    from staylens.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    rows = sorted(((False, r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op4_decontaminate"](spark, sf_small).collect()), key=str)
    assert rows == sorted(((*w[:4], len(w[4]), hashlib.sha256(",".join(w[4]).encode()).hexdigest(), w[3] > 0) for w in plain(docs, items)), key=str)
