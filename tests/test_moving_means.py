"""Means that a stream moves, against trees built of all members at once, and against batches that are repeated."""

import random

import pytest

from seqloom.config import SketchConfig
from seqloom.operators import trees
from seqloom.streaming import means as moving


def signature(r, centre):
    return sorted(b for b in range(60) if (b % 4 == centre) != (r.random() < 0.2))


@pytest.fixture(scope="module")
def tree(spark):
    """Root 100 over branches 10 and 20, leaves 1..5, one of a single member; a leaf of its own hangs from the same."""
    nodes = spark.createDataFrame([(10, 100), (20, 100), (1, 10), (2, 10), (3, 20), (4, 20), (5, 100)], "node long, parent long")
    r = random.Random(2)
    held = [(n, 10 * n + i, b) for n in range(1, 6) for i in range(1 if n == 4 else 4) for b in signature(r, n % 4)]
    return nodes, spark.createDataFrame(held, "node long, seq_id long, bit int")


def state(spark, path):
    return {r["node"]: r["bits"] for r in moving.means(spark, path).collect()}


def built(nodes, members):
    out = {r["node"]: [] for r in nodes.collect()} | {100: []}
    for r in trees.centroids(nodes, members).collect():
        out[r["node"]].append(r["bit"])
    return {n: sorted(b) for n, b in out.items()}


def test_batches_equal_a_rebuild(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(moving, "FOLD", 2)
    nodes, members = tree
    path, r = str(tmp_path / "state"), random.Random(4)
    moving.begin(nodes, members, path)
    assert state(spark, path) == built(nodes, members)
    batches = [[(1000 + 100 * n + i, signature(r, r.randrange(4))) for i in range(6)] for n in range(3)]
    batches[0].append((1999, []))  # without bits: has a leaf, no vote
    batches.insert(1, [])
    rows = [spark.createDataFrame(b, "seq_id long, bits array<int>") for b in batches]
    came = lambda: {(x["seq_id"], x["node"]) for x in moving.members(spark, path).collect()}
    before = None
    for n, batch in enumerate(rows):
        moving.advance(batch, nodes, path, n)
        if n in (2, 3):  # repeated as after a failure, on a sum and beside one
            before = state(spark, path), came()
            moving.advance(batch, nodes, path, n)
            assert (state(spark, path), came()) == before
    stands = came()
    assert len(stands) == 19 and {s for s, _ in stands} == {s for b in batches for s, _ in b}
    bits = dict(x for b in batches for x in b)
    more = spark.createDataFrame([(n, s, b) for s, n in stands for b in bits[s]], "node long, seq_id long, bit int")
    assert state(spark, path) == built(nodes, members.unionByName(more))


def test_arrivals_move_their_leaf_only(spark, tree, tmp_path):
    nodes, members = tree
    path = str(tmp_path / "state")
    moving.begin(nodes, members, path)
    old = state(spark, path)
    moving.advance(spark.createDataFrame([(7, old[3]), (7, old[3])], "seq_id long, bits array<int>"), nodes, path, 0)
    stands = [(r["node"], r["hd"]) for r in moving.members(spark, path).collect()]
    assert stands == [(3, 0), (3, 0)]  # equal ids are two members
    new = state(spark, path)
    assert all(new[n] == old[n] for n in (1, 2, 4, 5, 10)) and set(new) == set(old)


def test_stream(spark, tree, tmp_path):
    nodes, members = tree
    r = random.Random(1)
    for part in range(2):
        rows = [(part * 10 + i, "".join(r.choice("ACGT") for _ in range(40))) for i in range(3)]
        spark.createDataFrame(rows, "seq_id long, seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "state")
    moving.begin(nodes, members, path)
    stream = spark.readStream.schema("seq_id long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        moving.follow(stream, nodes, SketchConfig(k=9, w=9, s=1, n_elements=4), path, str(tmp_path / "ck"), once=True).awaitTermination()
        assert sorted(r["seq_id"] for r in moving.members(spark, path).collect()) == [0, 1, 2, 10, 11, 12]
