"""JSON arrays split at any byte against a whole parse."""

import json
import random

import pytest

from staylens.sources.csv import read_payload
from staylens.sources.json_array import read_elements


def parsed(df):
    return sorted(json.dumps(json.loads(r["value"]), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("bytes_a_split", [7, 64, 1000, 1 << 27])
def test_equals_a_whole_parse_at_any_split(spark, tmp_path, bytes_a_split):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice('ab,"\\[]{}: é\n') for _ in range(rng.randint(0, 25)))
    items = [rng.choice([{"k": text(), "n": [1, {"x": text()}]}, text(), 5, None, [text(), [2, 3]], {}]) for _ in range(60 if bytes_a_split < 50 else 300)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(" \n" + json.dumps(items, ensure_ascii=False) + "\n ")
    (folder / "b.json").write_text(json.dumps(items[:9], indent=1))
    (folder / "c.json").write_text("[]")
    (folder / "d.json").write_text("[7]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1 if bytes_a_split < 1 << 20 else 4 << 20)
    try:
        got = parsed(read_elements(spark, str(folder)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", 4 << 20)
    assert got == sorted(json.dumps(x, sort_keys=True) for x in [*items, *items[:9], 7])


def test_no_array_and_broken_arrays(spark, tmp_path):
    for k, text in enumerate(['{"hotel": "A", "adr": 2}', '[{"hotel": "B"}, {"hotel": ', '[{"hotel": "C"}, oops, {"nope": 1}]']):
        (tmp_path / f"{k}.json").write_text(text)
    valid, invalid = read_payload(spark, str(tmp_path), "array")
    assert sorted(r["hotel"] for r in valid.collect()) == ["A", "B", "C"]
    assert sorted(r["value"].strip() for r in invalid.collect()) == ["oops", '{"hotel":', '{"nope": 1}']


def test_marks_equal_the_state_read_mark_by_mark():
    from staylens.sources.json_array import effect, marks

    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice('ab,"\\[]{}"é') for _ in range(rng.randint(0, 14))) + ","
        for inside in (False, True):
            found = marks(text.encode(), inside, 2)
            assert (bool(found.inside[-1]), int(found.depth[-1])) == effect(text, inside, 2)


def test_payload_of_both_kinds_in_one_pass(spark, tmp_path):
    from staylens.sources.csv import checked_payload

    (tmp_path / "a.json").write_text('[{"hotel": "A", "adr": 2.5},{"hotel": "B", "nope": 1}, 5]')
    got = {r["value"].strip(): (r["invalid"], r["unknown"]) for r in checked_payload(spark, str(tmp_path), "array").collect()}
    assert got == {'{"hotel": "A", "adr": 2.5}': (False, []), '{"hotel": "B", "nope": 1}': (True, ["nope"]), "5": (True, None)}
