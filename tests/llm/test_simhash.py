import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from staylens.llm import hashing
from staylens.llm import simhash as S


def plain_print(text):
    """A fingerprint by one vote after another; the hash of a term is the operator's."""
    def hashed(part):
        data = np.frombuffer(part.encode(), np.uint8)
        h, down = hashing.prefix_sums(data, lower=True)
        return hashing.mix64((h[-1:] - h[:1]) * down[:1])

    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w.decode()) for w in text.encode().split()]
    votes = Counter()
    terms = [(hashed(w), S.WORD_WEIGHT * (n.bit_length())) for w, n in Counter(words).items()]
    shingles = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    for s in shingles:
        data = np.frombuffer(s.encode(), np.uint8)
        terms.append((hashing.mix64(hashing.shingle_sets(data, np.array([0, len(data)]), 5)[1] + np.uint64(5)), S.SHINGLE_WEIGHT))
    for h, weight in terms:
        for k in range(S.BITS // 64):
            lane = int(hashing.mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))[0]).to_bytes(8, "little")
            for b in range(64):
                votes[64 * k + b] += weight if lane[b // 8] >> (7 - b % 8) & 1 else -weight
    return np.packbits([votes[b] > 0 for b in range(S.BITS)]).tobytes().hex()


def likeness(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / S.BITS


def plain(rows, follows):
    out = []
    for k, (i, t) in enumerate(rows):
        text, nxt = t or "", follows[k]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        a, b, c = plain_print(text), plain_print(edited), plain_print(nxt)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return out


@pytest.fixture(scope="module")
def rows(corpus):
    return [r for r in corpus if len(r[1] or "") < 20_000 and r[0] is not None and r[0] != 903]


def test_equals_brute_force(spark, rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    follows = [t or "" for _, t in ordered[1:] + ordered[:1]]
    for tasks in (1, 6, 300):  # more tasks than rows, too
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        try:
            got = S.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        assert [tuple(r) for r in sorted(got, key=lambda r: -r.doc_id)] == plain(ordered, follows)


def test_repeated_rows_nulls_and_one_id(spark, corpus, corpus_df):
    got = S.compare_edited(corpus_df).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in corpus)
    by_text = {}
    prints = S.fingerprint(corpus_df).collect()
    for r in prints:
        assert by_text.setdefault(r.text or "", r._fingerprint) == r._fingerprint
    assert by_text[""] == "0" * (S.BITS // 4)
    one = spark.createDataFrame([(None, f"text {k % 5} of one id") for k in range(60)], "doc_id long, text string")
    assert len(S.compare_edited(one).collect()) == 60  # repeated rows follow each other
    assert sum(r.near_next == 1 for r in S.compare_edited(one).collect()) >= 55
    alone = S.compare_edited(spark.createDataFrame([(1, "one text here")], "doc_id int, text string")).collect()
    assert alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(S.half_edited("one text here", "one text here").encode()).hexdigest()


def test_likeness_tells_edited_texts_from_others(spark):
    got = [r for r in S.compare_edited(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.n_chars >= 100]
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.1


def test_groups_equal_brute_force(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(S.BITS) for _ in range(12)]
    values = []
    for k in range(400):
        x = centres[k % 12]
        for b in rng.sample(range(S.BITS), rng.randint(0, 6)):
            x ^= 1 << b
        values.append(x)
    values += [rng.getrandbits(S.BITS) for _ in range(50)] + [values[0]] * 9
    rows = [(k, f"{x:032x}") for k, x in enumerate(values)] + [(9000, None), (None, f"{values[3]:032x}")]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    for radius, block, blocks in ((4, 1 << 14, None), (4, 16, None), (3, 64, 6), (0, 8, 1)):
        n = len(rows)
        near = [[b for b in range(n) if b != a and rows[a][1] and rows[b][1] and (int(rows[a][1], 16) ^ int(rows[b][1], 16)).bit_count() <= radius] for a in range(n)]
        group = list(range(n))
        for a in range(n):
            todo, seen = [a], {a}
            while todo:
                for b in near[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            group[a] = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        want = sorted(((rows[k][0] is None, rows[k][0], len(near[k]), group[k]) for k in range(n)), key=str)
        got = S.near_groups(df, radius=radius, block=block, blocks=blocks).collect()
        assert sorted(((r.doc_id is None, r.doc_id, r.n_near, r.component_id) for r in got), key=str) == want


def test_blocks_grow_with_the_number_of_fingerprints():
    assert S.blocks_wanted(1000, 4) == 5 and S.blocks_wanted(1 << 40, 4) > 5
    assert all(len(S.block_tables(4, n)[0]) == n - 4 for n in (5, 6, 7))


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.compare_edited(empty).collect() == [] and S.fingerprint(empty).collect() == []
    assert S.near_groups(S.compare_edited(empty)).collect() == []
    rows = spark.createDataFrame([(1, "a b", "x", 1, "p", 4)], "doc_id long, text string, _fingerprint string, n_near int, print string, _name int")
    got = S.near_groups(S.fingerprint(rows), column="_fingerprint").collect()[0]
    assert (got.n_near, got.component_id, got.print, got._name) == (0, 1, "p", 4) and got._fingerprint != "x"
