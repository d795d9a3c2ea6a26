"""Rows against blocks of a smaller table, and what is built on them, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import aggregates, facing, sketches


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(facing, "BLOCK", 4)


def test_every_row_meets_every_other(spark):
    rows = spark.range(50).withColumn("seq_id", F.lit(7).cast("long"))  # one key for all rows
    few = spark.createDataFrame([(f"n{i:02d}", i) for i in range(10)], "name string, x int")
    got = facing.facing(rows, F.col("seq_id"), few, "name").collect()
    assert sum(len(r["block"]) for r in got) == 500 and max(len(r["block"]) for r in got) < 10
    assert {(r["id"], b["name"], b["x"]) for r in got for b in r["block"]} == {(i, f"n{j:02d}", j) for i in range(50) for j in range(10)}
    assert facing.facing(rows, F.col("seq_id"), few.limit(0), "name").count() == 0


def test_membership(spark):
    r = random.Random(8)
    held = {f"s{i}": set(r.sample(range(40), 20)) for i in range(9)} | {"all": set(range(40)), "other": {99}}
    asked = {i: r.sample(range(40), r.randrange(1, 5)) for i in range(20)} | {20: [], 21: [3, 3]}
    signatures = spark.createDataFrame([(n, b) for n, bits in held.items() for b in bits], "source string, bit int")
    got = sketches.membership(spark.createDataFrame(list(asked.items()), "seq_id long, bits array<int>"), signatures, "source").collect()
    want = {}
    for i, bits in asked.items():
        for n, own in held.items():
            if bits:
                missing, found = sorted(set(bits) - own), sorted(set(bits) & own)
                want[i, n] = (not missing, not found, missing[0] if missing else None, found[0] if found else None)
    assert {(r["seq_id"], r["source"]): (r["contains_all"], r["contains_none"], r["first_missing"], r["first_found"]) for r in got} == want
    assert len(got) == len(want)


def test_nearest_centre(spark):
    r = random.Random(9)
    points = [(i, [r.random() for _ in range(3)]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, None)]
    centres = [(c, [r.random() for _ in range(3)]) for c in range(9)] + [(9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0, 0.0])]
    centres = [(c, [x * 0 + 5 for x in v] if c == 3 else v) for c, v in centres]
    got = aggregates.nearest_centre(spark.createDataFrame(points, "vec_id long, v array<double>"), spark.createDataFrame(centres, "cluster int, centre array<double>"), "vec_id", "v")
    found = {x["vec_id"]: (x["cluster"], x["d"]) for x in got.collect()}
    assert found.pop(41) == (0, None)
    for i, v in points[:-1]:
        d, c = min((round(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) ** 0.5, 9), c) for c, w in centres)
        assert found[i][0] == c and abs(found[i][1] - d) < 1e-8
    assert len(found) == 41
