"""Members as arrays, a row each, against rows of single bits."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import aggregates, clustering, sketches, trees, windowed
from seqloom.streaming import means as moving


@pytest.fixture(scope="module")
def both(spark):
    r = random.Random(3)
    rows = [(f"g{i % 3}", i, sorted(r.sample(range(30), r.randrange(9)))) for i in range(30)] + [("alone", 90, [1, 2])]
    arrays = spark.createDataFrame(rows, "node string, seq_id long, bits array<int>")
    return arrays, sketches.bit_rows(arrays)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_means_and_distances(both):
    arrays, bits = both
    for how in ("majority", "strict", "or", "and"):
        assert rows(aggregates.mean_signature(arrays, how, "node")) == rows(aggregates.mean_signature(bits, how, "node"))
    for f in (lambda m: aggregates.priority(m, "node"), lambda m: aggregates.farthest(m, "node"), trees.poles):
        assert rows(f(arrays)) == rows(f(bits))


def test_stream_begins_alike(spark, both, tmp_path):
    nodes = spark.createDataFrame([(n, "root") for n in ("g0", "g1", "g2", "alone")], "node string, parent string")
    for name, members in zip(("a", "b"), both, strict=True):
        moving.begin(nodes, members, str(tmp_path / name))
    for part in ("votes", "sizes", "means"):
        got = [rows(spark.read.parquet(str(tmp_path / name / part))) for name in ("a", "b")]
        assert got[0] == got[1] and got[0]


def test_window_keys(spark):
    r = random.Random(5)
    seqs = [(i, "".join(r.choice("ACGT") for _ in range(r.randrange(400)))) for i in range(24)] + [(50, "")]
    df = spark.createDataFrame(seqs, "seq_id long, seq string")
    from seqloom.plans.base import CFG

    keys = sketches.window_keys(df, CFG)
    split = sketches.bit_rows(sketches.windowed(df, CFG))
    apart = keys.select("seq_id", F.explode("bits").alias("b")).select("seq_id", F.floor(F.col("b") / sketches.WINDOW).cast("int").alias("window_id"), F.pmod("b", F.lit(sketches.WINDOW)).cast("int").alias("bit"))
    assert rows(apart) == rows(split) and keys.count() == 25
    group = (F.col("seq_id") % 5).alias("grp")
    got = windowed.truncated_mean_keys(keys.select(group, "seq_id", "bits"), "grp")
    want = windowed.truncated_mean(split.select(group, "seq_id", "window_id", "bit"), "grp")
    assert rows(got) == rows(want.select("grp", (F.col("window_id").cast("long") * sketches.WINDOW + F.col("bit")).alias("bit")))


def test_nearest_by_blocks(spark):
    r = random.Random(6)
    big = sketches.WINDOW * 5000  # beyond 31 bits
    data = {i: sorted(r.sample(range(12), r.randrange(7))) for i in range(40)}
    centres = {c: sorted(r.sample(range(12), 4)) for c in range(4)}
    df = spark.createDataFrame([(i, [big + b for b in x]) for i, x in data.items()], "seq_id long, bits array<bigint>")
    of = spark.createDataFrame([(c, big + b) for c, x in centres.items() for b in x], "cluster int, bit bigint")
    want = {i: min((len(set(x) ^ set(y)), c) for c, y in centres.items()) for i, x in data.items()}
    assert {x["seq_id"]: (x["hd"], x["cluster"]) for x in clustering.nearest_by_blocks(clustering._key_blocks(df), of).collect()} == want
