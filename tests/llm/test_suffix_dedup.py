import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from staylens.llm import suffix_dedup as S


def plain(rows, length):
    """Brute force: (n_bytes, n_removed, n_spans, digest) of each row."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept, last = b"", 0
        for a, b in spans:
            kept, last = kept + t[last:a], b
        kept += t[last:]
        out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def got(df, **more):
    return sorted((r.doc_id is None, r.doc_id, r._n_bytes, r._n_removed, r._n_spans, r._sha256) for r in S.remove_repeats(df, whole_characters=False, **more).collect())


def test_equals_brute_force(corpus, corpus_df):
    want = sorted((i is None, i, *p) for (i, _), p in zip(corpus, plain(corpus, S.LENGTH), strict=True))
    assert got(corpus_df) == want
    assert any(w[3] for w in want)


@pytest.mark.parametrize("wide", [1, 4])
def test_wide_buckets_equal_brute_force(spark, corpus, corpus_df, monkeypatch, wide):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, variants = text(260), []
    for k in range(40):  # one passage, whole or cut, between texts of their own: many contexts of the same grams
        a, b = rng.choice([(0, 260), (0, 199), (30, 260), (20, 221), (61, 260)])
        variants.append((3000 + k, text(rng.randint(0, 300)) + core[a:b] + text(rng.randint(0, 300))))
    rows = corpus + variants
    monkeypatch.setattr(S.repeat_occurrences, "__defaults__", ("doc_id", "text", S.LENGTH, S.GRAM, wide, False))
    want = sorted((i is None, i, *p) for (i, _), p in zip(rows, plain(rows, S.LENGTH), strict=True))
    assert got(corpus_df.union(spark.createDataFrame(variants, "doc_id long, text string"))) == want


def test_rows_of_one_id_and_like_hashes_keep_their_own_spans(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = text(288)
    rows = [(None, shared + text(64)), (None, text(900)), (None, text(40) + shared), (None, text(500))]
    monkeypatch.setattr(S, "_named", lambda t: (F.xxhash64(t).alias("_t"), F.lit(7).alias("_u")))  # 32 bits that are alike
    monkeypatch.setattr(S, "_same_row", lambda a, b: F.col(f"{a}._t").eqNullSafe(F.col(f"{b}._t")) & F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")))
    found = S.repeat_occurrences(spark.createDataFrame(rows, "doc_id long, text string")).select("_t", "start", "stop").collect()
    assert len({r._t for r in found}) == 2
    monkeypatch.undo()
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == sorted((True, None, *p) for p in plain(rows, S.LENGTH))


def test_intervals_and_maximal_repeats():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 9)
        contexts = list({("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))).encode(), b"g" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 5))).encode()) for _ in range(n)})
        cover, found = S.repeats(contexts, 4)
        pairs = {}
        for i, (a, b) in enumerate(contexts):
            reach = [(S.common_prefix(a, x), S.common_prefix(b, y)) for j, (x, y) in enumerate(contexts) if j != i]
            reach = [r for r in reach if sum(r) >= 4]
            assert cover[i] == (max((r[0] for r in reach), default=0), max((r[1] for r in reach), default=0))
            for r in reach:
                pairs.setdefault(r, set())
        want = set()
        for before, behind in pairs:
            names = {}
            for i, (a, b) in enumerate(contexts):
                if len(a) >= before and len(b) >= behind:
                    names.setdefault((a[:before], b[:behind]), []).append(i)
            for members in names.values():
                if len(members) > 1:
                    left = min(S.common_prefix(contexts[members[0]][0], contexts[m][0]) for m in members[1:])
                    right = min(S.common_prefix(contexts[members[0]][1], contexts[m][1]) for m in members[1:])
                    if (left, right) == (before, behind):
                        want.add((before, behind, tuple(sorted(members))))
        assert {(a, b, tuple(sorted(m))) for a, b, m in found} == want and len(found) == len(want)


def test_groups_hold_all_occurrences(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = text(230)
    rows = [(k, text(300) + shared + text(300)) for k in range(5)] + [(9, text(900))]
    found = S.repeat_occurrences(spark.createDataFrame(rows, "doc_id long, text string"), groups=True).collect()
    by_group = {}
    for r in found:
        by_group.setdefault(r.group, set()).add((r._id, r.start, r.stop))
    for places in by_group.values():
        names = {rows[[i for i, _ in rows].index(d)][1][a:b] for d, a, b in places}
        assert len(names) == 1  # the occurrences of one string, and all of them
        name = names.pop()
        assert places == {(d, k, k + len(name)) for d, t in rows for k in range(len(t)) if t.startswith(name, k)}
    assert any(len(g) == 5 for g in by_group.values())


def test_text_keeps_whole_characters(spark):
    # the copies differ before and after: the first shared byte is inside a character
    a, b = "é" + "x" * 198 + "é", "è" + "x" * 198 + "è"
    cut = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame([(1, "k" + a), (2, "l" + a), (3, "m" + b + "y" * 3)], "doc_id long, text string")).collect()}
    assert cut[1].text == "k" and cut[2].text == "l" and cut[1]._n_removed == 202
    assert cut[3].text.startswith("m") and "�" not in cut[3].text


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(empty) == []
    rows = spark.createDataFrame([(1, "a" * 500, 7, "x", [1])], "doc_id long, text string, _n_bytes int, start string, _spans array<int>")
    r = S.remove_repeats(rows).collect()[0]
    assert (r._n_bytes, r._n_removed, r.start, r.text) == (500, 500, "x", "")
