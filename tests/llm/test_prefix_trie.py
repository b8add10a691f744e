import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from staylens.llm import prefix_trie as T

SCHEMA = "conv_id long, turn int, role string, text string"


def conversations(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(turns)] for c, turns in convs.items()}


def shared(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, who in members.items():
        cost = (len(who) - 1) * len(k[-1][1].encode().split()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += cost
    return sorted((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(who) if len(convs[c]) == len(k)).encode()).hexdigest())
                  for k, who in members.items())


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for c in [*range(-25, 90), 5000, 10**15]:
        n = rng.choice([1, 2, 3, 4, 9, 30]) if c % 7 else 2
        for t in range(n):  # few texts, so that many conversations begin alike
            out.append((c, t, rng.choice(["user", None]) if t % 3 else "user", rng.choice(["a b", "", None, "c  d\te", "Ü"]) if rng.random() < 0.4 else "same"))
    long = [(77, None if t < 40 else t, "user", f"turn {t % 13}") for t in range(700)]  # a third of all rows, many without a turn number
    copies = [(6000 + k, t, "user", f"x {t}") for k in range(300) for t in range(3)]
    edge = [(None, 1, "user", "no conversation"), (81, None, None, None), (82, 1, "user", "tie"), (82, 1, "user", "tie"), (82, 1, "assistant", "tie"), (82, 1, "r" * 70, "b"), (82, 1, "r" * 71, "a")]
    return out + long + copies + edge


@pytest.mark.parametrize("band", [2, 8, 1000])
def test_equals_brute_force(spark, rows, band):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(T.prefix_trie(df, band=band)) == plain(conversations(rows))


def test_shared_heads_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(T.trie(*T.share_heads(T.number_turns(df), 20, 4))) == plain(shared(conversations(rows)))


def test_long_conversation_spreads_over_tasks(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).where("conv_id = 77")
    numbered = T.number_turns(df)
    assert sorted(r.pos for r in numbered.collect()) == list(range(1, len([r for r in rows if r[0] == 77]) + 1))


def test_id_runs_of_copies(spark, monkeypatch):
    monkeypatch.setattr(T, "ID_RUN", 16)
    rows = [(c, t, "user", f"x {t}") for c in range(-40, 200) for t in range(2)]
    assert got(T.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(conversations(rows))


def test_turnless_empty_and_clashing_columns(spark):
    # conversations whose own turns all go and that get none in their place are members of the root alone
    ids = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3]
    rows = [(c, 0, "user", "only") for c in ids]
    assert got(T.trie(*T.share_heads(T.number_turns(spark.createDataFrame(rows, SCHEMA)), 20, 4))) == [
        (ids[0], 0, None, len(ids), 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
    assert got(T.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    assert got(T.prefix_trie(spark.createDataFrame([(None, 0, "a", "b")], SCHEMA))) == []
    more = spark.createDataFrame([(c, t, r, x, 1, "p", [2]) for c, t, r, x in rows], SCHEMA + ", c int, pos string, v0 array<int>")
    assert got(T.prefix_trie(more)) == plain(conversations(rows))
