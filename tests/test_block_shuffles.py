"""Pairs of blocks meet where the blocks lie: against brute force over many blocks, and no shuffle by pair in the plan."""

import random

from pyspark.sql import functions as F

from seqloom.operators import block_pairs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flat_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(block_pairs, "BLOCK", 5)
    monkeypatch.setattr(block_pairs, "BITS", 40)  # blocks of few bits, too
    monkeypatch.setattr(block_pairs, "SLICE", 2)
    r = random.Random(3)
    rows = [(i, sorted(r.sample(range(60), r.choice([0, 2, 9, 30])))) for i in range(40)]
    df = spark.createDataFrame(rows, "seq_id long, bits array<int>")
    found = block_pairs.counted(df)
    assert "CartesianProduct" in plan(found) and "Exchange" not in plan(found)
    want = {(i, j): len(set(x) & set(y)) for i, x in rows for j, y in rows if i < j and set(x) & set(y)}
    assert {(p["i"], p["j"]): p["inter"] for p in found.collect()} == want
    near = block_pairs.product(df, df.withColumnRenamed("seq_id", "node"), within=8)
    assert "CartesianProduct" in plan(near) and "Exchange" not in plan(near)
    want = {(i, j) for i, x in rows for j, y in rows if x and y and len(set(x) ^ set(y)) <= 8}
    assert {(p["seq_id"], p["node"]) for p in near.collect()} == want


def test_windowed_pairs_are_not_shuffled(spark, monkeypatch):
    from seqloom.operators import pairs, windowed

    monkeypatch.setattr(block_pairs, "BLOCK", 5)
    monkeypatch.setattr(block_pairs, "POSTINGS", 10)
    r = random.Random(5)
    seqs = {i * 7 % 31: [r.sample(range(8), r.randint(1, 3)) for _ in range(r.randint(1, 6))] for i in range(31)}
    bits = spark.createDataFrame([(i, w, b) for i, x in seqs.items() for w, own in enumerate(x) for b in own], "seq_id long, window_id int, bit int")
    n = spark.createDataFrame([(i, len(x)) for i, x in seqs.items()], "seq_id long, n long")
    local, anchored, matching, measured, hamming = {}, {}, {}, {}, {}
    for i, x in seqs.items():
        for j, y in seqs.items():
            each = [(len(set(a) & set(b)), len(set(a) | set(b)), len(a) + len(b)) for a, b in zip(x, y, strict=False)]
            if i >= j or not any(c for c, *_ in each):
                continue
            shares = [c / u for c, u, _ in each]
            local[i, j] = round(sum(shares) / len(each), 9)
            first = next((k for k, (c, *_) in enumerate(each) if c >= 2), None)
            if first is not None:
                anchored[i, j] = round(sum(shares[first:]) / (len(each) - first), 9)
            matching[i, j] = round(sum(c >= 2 or 0 < c == u for c, u, _ in each) / max(len(x), len(y)), 9)
            c, sizes = sum(c for c, *_ in each), [sum(map(len, s)) for s in (x, y)]
            measured[i, j] = (c, sum(sizes) - c, sum(sizes) - 2 * c, sum(s for *_, s in each) - 2 * c, round(c / sizes[1], 9))
            hamming[i, j] = sum(sizes) - 2 * c
    value = lambda df: {(p["i"], p["j"]): p["x"] for p in df.withColumn("x", F.round(df.columns[-1], 9)).collect()}
    assert value(pairs.local_jaccard(bits, n)) == local
    assert value(pairs.local_jaccard(bits, n, 2)) == anchored
    assert value(pairs.matching_windows(bits, n, 2)) == matching
    assert value(pairs.windowed_hamming(bits)) == hamming
    got = windowed.measures(bits)
    assert "CartesianProduct" in plan(got) and "Exchange" not in plan(got)
    assert {(p[0], p[1]): (*p[2:6], round(p[6], 9)) for p in got.collect()} == measured


def test_signatures_of_trees_are_computed_once(spark):
    """What reads a tree's members several times reads files of signatures, not texts."""
    from conftest import DATA

    from seqloom.plans import tree_queries

    _, members = tree_queries._leaves(spark, DATA)
    assert members.inputFiles() and all("signatures-" in f for f in members.inputFiles())


def test_kmeans_computes_signatures_once(spark, monkeypatch):
    from seqloom.operators import clustering

    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def bits(i):
        calls.add(1)
        return [i, 10 + i]

    df = spark.range(6).select(F.col("id").cast("int").alias("seq_id"), bits(F.col("id").cast("int")).alias("bits"))
    clustering.kmeans(df, 2, 3).collect()
    assert calls.value == 6
