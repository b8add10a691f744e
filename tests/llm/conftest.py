import random

import pytest


@pytest.fixture(scope="session", autouse=True)
def code(spark):
    from staylens.llm.common import show_code

    show_code(spark)


def words(rng, n, letters="aeiounrst"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


#: Rows of (doc_id, text) that every operator on documents must take: nulls, empty, blank, control characters, repeated rows.
EDGE = [(None, "a text without an id"), (None, None), (900, None), (901, ""), (902, " \t\n"), (903, "ok"), (903, "ok"), (904, "\x00\x01"), (905, "ÀÉ ñandú 東京 \U0001f600")]


@pytest.fixture(scope="session")
def corpus():
    """Rows of (doc_id, text): prose, exact and near copies, shared passages, periodic and long texts, and EDGE."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(3, 160)) for _ in range(40)]
    passage = words(rng, 70)
    docs = [*base, base[0], base[0], base[3].upper()]
    for k in range(12):  # near copies of one long text, some on either side of the bound
        copy = (base[k % 3] + " " + words(random.Random(k % 3), 150)).split(" ")
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = "x" + str(rng.randint(0, 99))
        docs.append(" ".join(copy))
    docs += [words(rng, rng.randint(0, 30)) + " " + passage + " " + words(rng, rng.randint(0, 30)) for _ in range(15)]
    docs += ["ab" * 400, "ab" * 400 + "c", words(rng, 6000), "é" * 300 + passage[:150], passage[40:239], passage[40:240], passage[40:241]]
    return list(enumerate(docs)) + EDGE


@pytest.fixture(scope="session")
def corpus_df(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
