import re

import pytest

from staylens.llm import license_scan as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """Brute force: words, starts of base places, base labels."""
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted(k for p in S.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    labels = sorted({label for p, label in S.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()})
    return len(w), places, labels


TEXTS = [None, "", "Under the MIT license.", "under the mit license under the mit license", "CC BY-NC cc by nc, CC-BY", "Apache License, Version 2.0", "apache license version 20", "Éunder the mit license",
         "xcc by nc", "cc by\nnc", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nOR x", "spdx-license-identifier: mit or", "GNU General Public License, version 3",
         "cc by nc " * 2000 + "apache license version 2"]


def test_base_equals_brute_force(spark, corpus):
    rows = corpus + list(enumerate(TEXTS, 2000))
    got = S.scan_licences(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _places int").repartition(3)).collect()
    assert sorted(((r.doc_id, r._n_words, r._places, r._base) for r in got), key=str) == sorted(((i, *plain(t)) for i, t in rows), key=str)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2010]._labels == ["apache-2.0", "gpl-2.0-only with classpath-exception-2.0", "mit"] and by_id[2010]._base == []
    assert by_id[2011]._labels == [] and by_id[2012]._labels == ["gpl-3"]
    assert all(0 <= r._score <= 1 and set(r._base) <= set(r._labels) for r in got)


@pytest.mark.parametrize("text, postfix", [("MIT", ["mit"]), ("a OR b AND c", ["a", "b", "c", "and", "or"]), ("(a or b) and c", ["a", "b", "or", "c", "and"]),
                                           ("a with e and b", ["a", "e", "with", "b", "and"]), ("a and b and c", ["a", "b", "and", "c", "and"]), ("a) or b", ["a"]), ("mit. And", None),
                                           ("GPL-2.0+ foo", ["gpl-2.0+"]), ("", None), ("or a", None), ("(a", None), ("a or", None), ("()", None)])
def test_shunting_yard(text, postfix):
    if postfix is None:
        with pytest.raises(ValueError):
            S.parse(text)
    else:
        assert S.parse(text) == postfix


def test_evaluation():
    assert S.allowed(S.parse("a or b and c"), {"a"}) and not S.allowed(S.parse("(a or b) and c"), {"a"})
    assert S.allowed(S.parse("a with e"), {"a", "e"}) and not S.allowed(S.parse("a with e"), {"a"})


def test_empty(spark):
    assert S.scan_licences(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("text, postfix", [("(MIT OR Apache-2.0", "mit apache-2.0 or"), ("MIT OR", "mit"), ("a and (b or", "a b and"), ("((a or b) and c", "a b or c and"), ("a or and b", "a"),
                                           ("a or )", "a"), ("(a) b (", "a"), ("(a b", "a"), ("or a", ""), ("()", ""), ("", "")])
def test_longest_complete_part(text, postfix):
    got, whole = S.longest(text)
    assert " ".join(got) == postfix and whole == (text == "(a) b (")


def test_expressions_are_evaluated(spark):
    tag = "SPDX-License-Identifier: "
    rows = [(1, f"{tag}MIT OR GPL-2.0-only"), (2, f"{tag}MIT AND GPL-2.0-only\n{tag}ISC"), (3, f"{tag}(MIT OR Apache-2.0\nx"), (4, f"{tag}OR"), (5, None),
            (6, f"{tag}Apache-2.0 WITH LLVM-exception")]
    got = {r.doc_id: r for r in S.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: [(e.postfix, e.complete, e.accepted) for e in r._expressions] for k, r in got.items()} == {
        1: [("mit gpl-2.0-only or", True, True)], 2: [("mit gpl-2.0-only and", True, False), ("isc", True, True)],
        3: [("mit apache-2.0 or", False, None)], 4: [], 5: [], 6: [("apache-2.0 llvm-exception with", True, True)]}
    assert got[3]._expressions[0].licences == ["apache-2.0", "mit"] and got[3]._labels == [] and got[3]._score == 0.5 and got[4]._score == 0
