import zlib
from collections import Counter

from staylens.llm import language_id as L


def plain_grams(text):
    """Brute force n-gram counts of words of letters, each with a blank on both sides."""
    out = Counter()
    word = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in word:
        p = f" {w} "
        out.update(w)
        out.update(p[k : k + 2] for k in range(len(p) - 1))
        out.update(p[k : k + 3] for k in range(len(p) - 2))
    return out


def test_counts_equal_brute_force(corpus, monkeypatch):
    texts = [t or "" for _, t in corpus] + ["İstanbul ß 1a2 a", "", "a"]
    for step in (1 << 20, 100):  # long texts are counted in steps
        monkeypatch.setattr(L, "_STEP", step)
        doc, gram, count = L.gram_counts(texts)
        for k, text in enumerate(texts):
            assert sorted(count[doc == k].tolist()) == sorted(plain_grams(text).values())


def test_out_of_place_distance():
    import numpy as np

    texts = ["abc abd", "xyz", "..."]
    doc, gram, count = L.gram_counts(texts)
    ranked = {k: [g for _, g in sorted(zip((-count[doc == k]).tolist(), gram[doc == k].tolist(), strict=True))] for k in range(3)}
    grams = np.array(sorted(ranked[0]))
    ranks = np.array([[ranked[0].index(g)] for g in grams])
    away, n = L.distances(texts, grams, ranks, 50)
    assert away[0, 0] == 0 and away[1, 0] == 50 * n[1] and n.tolist() == [len(ranked[0]), len(ranked[1]), 0]


def test_profiles_are_of_all_texts(spark):
    rows = [(1, "aa ab", "x"), (2, "ab ab", "x"), (3, "zz", "y"), (4, "qq", None), (5, None, "x")]
    found = L.fit_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", size=2).collect()
    assert {(r.lang, r.rank) for r in found} == {("x", 0), ("x", 1), ("y", 0), ("y", 1)}


def test_edge_rows(spark, corpus, corpus_df):
    langs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    out = L.identify(corpus_df, L.fit_profiles(langs, "lang")).collect()
    assert len(out) == len(corpus)
    for r in out:
        assert 0 <= r._score <= 1 and (r._lang == "und") == (not any(c.isalpha() for c in r.text or ""))
    none = L.identify(corpus_df, L.fit_profiles(langs.where("false"), "lang"))
    assert {r._lang for r in none.collect()} == {"und"}
    assert L.identify(corpus_df.where("false"), L.fit_profiles(langs, "lang")).collect() == []
    clash = spark.createDataFrame([("the cat", 4, "k")], "text string, _score int, lang string")
    r = L.identify(clash, L.fit_profiles(langs, "lang")).collect()[0]
    assert r._lang == "en" and 0 < r._score <= 1 and r.lang == "k"


def test_held_out_accuracy(spark):
    from staylens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_language_id"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and true[r.doc_id]]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) / len(held) > 0.97
