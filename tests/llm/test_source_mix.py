import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from staylens.llm import source_mix as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, **more):
    return sorted((tuple(r) for r in M.mix_sources(df, **more).collect()), key=str)


@pytest.fixture(scope="module")
def sourced(spark, corpus):
    names = ["a", "b", "B", "é", None, "tiny"]
    rows = [(i, t, "tiny" if i == 900 else names[k % 5] if k % 3 else "a") for k, (i, t) in enumerate(corpus)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_sizes_targets_and_taken(sourced):
    rows, df = sourced
    got = rows_of(df, block=8, slots=256)
    sizes, total = defaultdict(int), 0
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, M.water_fill([sizes[s] for s in order], [[5.0, 2.0, 1.0][k % 3] for k in range(len(order))], 3), strict=True))
    assert sum(targets.values()) == pytest.approx(total) and all(targets[s] <= 3 * sizes[s] for s in sizes)
    assert sorted(((i, s, n, m, t) for i, s, n, m, t, _ in got), key=str) == sorted(((i, s, len(WORD.findall(t or "")), sizes[s], targets[s]) for i, t, s in rows), key=str)
    taken = defaultdict(int)
    for _, s, n, _, _, k in got:
        assert 0 <= k <= 3 * n
        taken[s] += k
    assert all(abs(taken[s] - targets[s]) <= 0.05 * total ** 0.5 * targets[s] ** 0.5 + 40 for s in sizes)
    assert rows_of(df.repartition(7), block=8, slots=256) == got  # reruns agree


def test_water_fill():
    assert M.water_fill([100, 100, 100], [5, 2, 1], 3) == [187.5, 75.0, 37.5]
    out = M.water_fill([10, 1000, 0], [5, 2, 1], 3)
    assert out[0] == 30 and out[2] == 0 and out[1] == 980
    assert M.water_fill([], [], 3) == [] and M.water_fill([0], [1], 3) == [0.0]


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in range(3):
            assert sorted(M.permute(np.arange(n), n, key).tolist()) == list(range(n))
    assert M.permute(np.arange(1000), 1000, 1).tolist() != M.permute(np.arange(1000), 1000, 2).tolist()


def test_shard_counts():
    shares = np.array([0.5, 0.123, 0.377])
    counts = M.shard_counts(np.arange(500), 100, shares, 1)
    assert (counts.sum(1) == 100).all() and (np.abs(counts - shares * 100) <= 1 + 1e-9).all()
    assert np.abs(counts.sum(0) - shares * 50_000).max() < 60
    assert (M.shard_counts(np.array([7]), 100, shares, 1)[0] == counts[7]).all()


def test_empty(spark):
    assert rows_of(spark.createDataFrame([], "doc_id long, text string, source string")) == []
    assert rows_of(spark.createDataFrame([(1, None, None, 3)], "doc_id long, text string, source string, size int")) == [(1, None, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("block, slots", [(8, 256), (64, 1 << 16)])
def test_corpus_holds_the_documents_words(sourced, block, slots, tmp_path):
    rows, df = sourced
    corpus, docs = M.mix_corpus(df, block=block, slots=slots, path=f"{tmp_path}/mix")
    mixed, taken = corpus.collect(), docs.collect()
    texts = defaultdict(list)  # repeated rows are documents of their own
    for i, t, s in rows:
        texts[i, s].append(WORD.findall(t or ""))
    seen, spread = defaultdict(set), defaultdict(int)
    for r in mixed:
        words, at = WORD.findall(r.text), 0
        assert len(words) == r.n_words == sum(p.words for p in r.parts) and 0 < r.n_words <= block and 0 <= r.slot < slots
        for p in r.parts:
            piece = words[at : at + p.words]
            assert any(piece == t[k : k + p.words] for t in texts[p.doc_id, r.source] for k in range(len(t) - p.words + 1))
            at += p.words
            spread[p.doc_id, r.source] += p.words
        seen[r.source, r.block].add(r.text)
    places = [(r.shard, r.slot) for r in mixed]
    assert len(set(places)) == len(places) and sorted(r.shard * slots + r.slot for r in mixed) == list(range(len(mixed)))
    assert all(len(t) == 1 for t in seen.values())  # a block is the same words each time
    assert max(Counter((r.source, r.block) for r in mixed).values()) <= 3
    given = defaultdict(int)
    for r in taken:
        given[r.doc_id, r.source] += r.taken
    assert {k: n for k, n in given.items() if n} == dict(spread)
    for f in df.sparkSession.read.parquet(f"{tmp_path}/mix").inputFiles():
        part = [(r.shard, r.slot) for r in df.sparkSession.read.parquet(f).collect()]
        assert part == sorted(part)


def test_small_sources_reach_their_targets(spark):
    text = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    small = [(k, text(k, 70 if k % 2 else 10), f"s{k:03}") for k in range(60)] + [(99, text(99, 3), None)]
    rows = rows_of(spark.createDataFrame([*small, (100, text(100, 20_000), "big")], "doc_id long, text string, source string"), block=64)
    for i, _, size, _, target, taken in rows:  # three whole epochs of each small source
        assert taken == pytest.approx(target, abs=64 if i == 100 else 1e-6) and (i == 100 or target == 3 * size)
    alike = [(k, text(k, 70), f"s{k:03}") for k in range(300)]
    rows = rows_of(spark.createDataFrame(alike, "doc_id long, text string, source string"), block=64)
    for third in range(3):  # by weight
        part = [r for r in rows if r[0] % 3 == third]
        assert sum(r[5] for r in part) == pytest.approx(sum(r[4] for r in part), rel=0.2)


def test_slot_counts_meet_targets_on_average():
    sizes, targets = [10, 70, 130, 64, 0, 6400], [7.0, 100.0, 300.0, 192.0, 0.0, 5000.0]
    mean = np.mean([M.slot_counts(sizes, targets, 3, 64, seed) for seed in range(2000)], 0)
    assert mean == pytest.approx([0.7, 100 * 2 / 70, 300 * 3 / 130, 3, 0, 5000 / 64], abs=0.05)
