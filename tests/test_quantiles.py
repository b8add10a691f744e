"""Exact quantiles by rank selection: sorted lists say what they must be."""

import random

import numpy as np
import pytest

from staylens.functions import quantiles as Q


def rows():
    rng = random.Random(6)
    out = []
    for g in (0, 1, None):
        out += [(g, float(rng.choice([rng.gauss(0, 1), rng.expovariate(1e-6), -5.0, 2.0 ** rng.randint(-40, 40)]))) for _ in range(3000)]
    out += [(7, 4.0)] * 2500  # one value only
    out += [(8, float(k)) for k in range(10)] + [(9, None)] * 3
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("accuracy", [100, 10_000])  # groups of over 200 values go through brackets, or none does
def test_ranks_and_interpolation_equal_sorted_lists(spark, monkeypatch, accuracy):
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    data = rows()
    df = spark.createDataFrame(data, "g int, t double")
    qs = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p95": 0.95, "all": 1.0 - 1e-9, "none": 0.0}
    got = {r["g"]: r for r in Q.rank_quantiles(df, "t", qs, ["g"]).collect()}
    linear = {r["g"]: r for r in Q.linear_quantiles(df, "t", qs, ["g"]).collect()}
    assert set(got) == set(linear) == {0, 1, None, 7, 8}
    for g in got:
        s = sorted(v for k, v in data if k == g)
        assert got[g]["n"] == len(s) and [got[g][n] for n in qs] == [s[int(q * len(s))] for q in qs.values()]
        assert np.allclose([linear[g][n] for n in qs], np.quantile(s, list(qs.values())), rtol=1e-12)
    whole = Q.rank_quantiles(df, "t", qs).collect()
    s = sorted(v for _, v in data if v is not None)
    assert len(whole) == 1 and [whole[0][n] for n in qs] == [s[int(q * len(s))] for q in qs.values()]


def test_weights_repeat_values(spark):
    rng = random.Random(3)
    data = [(g, float(rng.randint(-50, 400)) / 4, rng.choice([1, 1, 2, 900])) for g in (1, 2) for _ in range(700)]
    df = spark.createDataFrame(data, "g int, t double, w long")
    for by in (["g"], []):
        got = Q.linear_quantiles(df, "t", {"q": 0.5, "p": 0.97}, by, weight="w").collect()
        for r in got:
            s = [v for g, v, w in data if not by or g == r["g"] for _ in range(w)]
            assert np.allclose([r["q"], r["p"]], np.quantile(s, [0.5, 0.97]), rtol=1e-12)
        assert len(got) == (2 if by else 1)


def test_no_values(spark):
    empty = spark.createDataFrame([], "g int, t double")
    assert Q.rank_quantiles(empty, "t", {"p": 0.5}, ["g"]).collect() == []
    assert [r["m"] for r in Q.linear_quantiles(empty, "t", {"m": 0.5}).collect()] == [None]


def test_no_range_is_sorted(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS t")
    plan = Q.rank_quantiles(df, "t", {"p": 0.9}, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 2 and "percentile_approx" in plan  # one window over what was counted
