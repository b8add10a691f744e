"""Cases as rows against one predicate per case."""

import random

import pytest
from pyspark.sql import functions as F

from staylens.operators.case_filters import match_cases
from staylens.operators.filters import condition

ROWS = "id long, hotel string, n int, x double, day date"


def rows(spark):
    rng = random.Random(4)
    data = [(k, rng.choice(["A", "B", "C", None, ""]), rng.choice([0, 1, 2, 50, None]), rng.choice([0.5, 1.0, 2.25, -3.0, None, 1e9]), None) for k in range(300)]
    return spark.createDataFrame(data, ROWS).withColumn("day", F.expr("date_add(DATE'2024-01-01', CAST(id % 5 AS INT))"))


CASES = {1: {"hotel": "A"}, 2: {}, 3: {"n": {"gt": 0}}, 4: {"n": {"gt": 0, "lt": 50}, "x": {"gt": -5.0}}, 5: {"hotel": "B", "x": {"lt": 2.25}}, 6: {"n": 1, "hotel": "C"},
         7: {"hotel": {"lt": "B"}}, 8: {"x": {"gt": 5.0, "lt": 1.0}}, 9: {"n": 2}, 10: {"x": 1.0, "n": {"gt": 0}}, 11: {"hotel": "none"}}


def specs(spark, cases):
    return (spark.createDataFrame([(c,) for c in cases], "case_id int"),
            spark.createDataFrame([(c, col, op, str(v)) for c, conds in cases.items() for col, x in conds.items() for op, v in (x.items() if isinstance(x, dict) else [("eq", x)])],
                                  "case_id int, column string, op string, value string"))


def test_equals_one_predicate_per_case(spark):
    df = rows(spark)
    got = {(r["case_id"], r["id"]) for r in match_cases(df, *specs(spark, CASES)).collect()}
    want = {(c, r["id"]) for c, conds in CASES.items() for r in df.where(condition(conds, df.columns)).select("id").collect()}
    assert got == want
    assert match_cases(df, *specs(spark, CASES)).count() == len(want)  # a row once per case


def test_unknown_columns_wrong_values_and_operators(spark):
    df = rows(spark)
    cases, conds = specs(spark, {1: {"hotel": "A", "colour": "red"}, 2: {"colour": "red"}, 3: {"hotel": "A"}, 4: {"n": "many"}})
    with pytest.raises(KeyError):
        match_cases(df, cases, conds)
    count = lambda mode: {r["case_id"]: r["count"] for r in match_cases(df, cases, conds, mode).groupBy("case_id").count().collect()}
    a = df.where("hotel = 'A'").count()
    assert count("ignore") == {1: a, 2: 300, 3: a} and count("empty") == {3: a}
    with pytest.raises(ValueError):
        match_cases(df, cases, conds.withColumn("op", F.lit("near")), "ignore")


def test_plan_does_not_grow_with_the_cases(spark):
    df = rows(spark)
    size = lambda n: len(match_cases(df, *specs(spark, {k: {"hotel": f"h{k}", "n": {"gt": k}} for k in range(n)}))._jdf.queryExecution().analyzed().toString())
    assert abs(size(200) - size(3)) < 2000


def test_nothing(spark):
    df = rows(spark)
    cases, conds = specs(spark, CASES)
    assert match_cases(df, cases.where("false"), conds.where("false")).collect() == []
    assert match_cases(df.where("false"), cases, conds).collect() == []
