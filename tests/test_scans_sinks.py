"""Signature files by byte ranges, list files, samples, and the writers, as round trips."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from seqloom.sources import scans, sinks, splits, tables


@pytest.fixture
def flat(spark, tmp_path):
    rows = [(i, sorted({i % 40, (7 * i) % 40, 39})) for i in range(300)]
    df = spark.createDataFrame(rows, "seq_id long, bits array<int>")
    sinks.signatures(df, 40, str(tmp_path / "flat"))
    return rows, str(tmp_path / "flat")


def test_flat_round_trip_in_splits(spark, flat):
    rows, folder = flat
    for split in (7, 64, None):  # a split may begin within a record
        got = scans.flat(spark, folder, split=split).orderBy("path", "seq_id").collect()
        assert [r["bits"] for r in got] == [b for _, b in rows]
    assert sum(n for _, n in splits.files([folder])) == 5 * 300 + 8 * len(splits.files([folder]))


def test_windowed_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "RUN", 4)
    want = [(s, w, [(s + w) % 16]) for s in range(40) for w in range(1 + s % 5)]
    df = spark.createDataFrame(want, "seq_id long, window_id int, bits array<int>")
    sinks.windowed_signatures(df.coalesce(1), 16, str(tmp_path / "w"))
    got = scans.windowed(spark, str(tmp_path / "w"), split=9)
    per_file = {}
    for r in got.orderBy("path", "seq_id", "window_id").collect():
        per_file.setdefault((r["path"], r["seq_id"]), []).append((r["window_id"], r["bits"]))
    assert [x for _, x in sorted(per_file.items())] == [[(w, b) for t, w, b in want if t == s] for s in range(40)]
    assert scans.first_sequences(got, 1).select("path").distinct().count() == len(splits.files([str(tmp_path / "w")]))
    drawn = scans.sampled_sequences(got, 5, 3)
    assert drawn.select("path", "seq_id").distinct().count() == 5
    whole = got.groupBy("path", "seq_id").count().join(drawn.groupBy("path", "seq_id").agg(F.count("*").alias("n")), ["path", "seq_id"])
    assert whole.where("count <> n").count() == 0
    one = spark.createDataFrame([(s, w, [w]) for s in range(12) for w in range(3)], "seq_id long, window_id int, bits array<int>")
    sinks.windowed_signatures(one, 16, str(tmp_path / "e"))
    assert scans.estimated_sequences(str(tmp_path / "e")) == sum((size - 8) // 2 // 3 for _, size in splits.files([str(tmp_path / "e")]))


def test_failed_attempts_leave_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, [i]) for i in range(8)], "seq_id long, bits array<int>")
    spark.dataSource.register(splits.SignatureSource)
    bad = df.repartition(2, "seq_id").withColumn("bits", F.when(F.col("seq_id") == 5, F.array(F.lit(99))).otherwise(F.col("bits"))).select("bits")
    with pytest.raises(Exception, match="index 99"):
        bad.write.format("signatures").option("bits", 16).mode("append").save(str(tmp_path / "f"))
    assert not os.path.isdir(tmp_path / "f") or not os.listdir(tmp_path / "f")
    writer = splits.Writer(str(tmp_path / "g"), 16, False)
    os.makedirs(tmp_path / "g")
    for attempt in (1, 2):  # the same task twice: only the one that reports is kept
        (tmp_path / "g" / f".{writer.job}-000000-{attempt}").write_bytes(b"\x02" + bytes(7) + b"\x01\x00")
    writer.commit([splits.Made(f"{tmp_path}/g/.{writer.job}-000000-2"), None])
    assert [r["bits"] for r in scans.flat(spark, str(tmp_path / "g")).collect()] == [[0]]
    assert len(os.listdir(tmp_path / "g")) == 1


def test_overwriting(spark, tmp_path):
    df = spark.createDataFrame([(0, [1])], "seq_id long, bits array<int>")
    for _ in range(2):
        sinks.signatures(df, 16, str(tmp_path / "o"), mode="overwrite")
    assert scans.flat(spark, str(tmp_path / "o")).count() == 1
    sinks.signatures(df, 16, str(tmp_path / "o"))
    assert scans.flat(spark, str(tmp_path / "o")).count() == 2


def test_list_files(spark, flat, tmp_path):
    rows, folder = flat
    names = [p for p, _ in splits.files([folder])]
    (tmp_path / "list.txt").write_text("\n".join(names) + "\n\n")
    assert scans.list_length(spark, str(tmp_path / "list.txt")) == len(names)
    assert scans.flat_list(spark, str(tmp_path / "list.txt")).count() == len(rows)
    some = scans.flat_list_sample(spark, str(tmp_path / "list.txt"), 1, 5).select("path").distinct().collect()
    assert len(some) == 1 and some == scans.flat_list_sample(spark, str(tmp_path / "list.txt"), 1, 5).select("path").distinct().collect()
    assert scans.windowed_list(spark, str(tmp_path / "list.txt")).select("seq_id").distinct().count() == 1  # no record of zeros: one sequence a file
    assert scans.windowed_list_sample(spark, str(tmp_path / "list.txt"), 1, 5).select("path").distinct().count() == 1


def test_files_by_name(spark, tmp_path):
    for k in (9, 17):
        (tmp_path / f"toy-k{k}-w100.csv").write_text("i,count\n0,%d\n" % k)
    (tmp_path / "other.csv").write_text("i,count\n0,1\n")
    got = scans.by_name(spark, str(tmp_path), "toy-*.csv", "i long, count long")
    assert {(r["parameter"], r["count"]) for r in got.collect()} == {(9, 9), (17, 17)}


def test_edges_and_clusters_and_mers(spark, tmp_path):
    tables.write_edges(spark.createDataFrame([(0, 1, 0.125)], "i long, j long, similarity double"), str(tmp_path / "e"))
    assert [tuple(r) for r in tables.edges(spark, str(tmp_path / "e")).collect()] == [(0, 1, 12.5)]
    tables.write_clusters(spark.createDataFrame([(3, 4)], "seq_id long, cluster long"), str(tmp_path / "c"))
    assert [tuple(r) for r in tables.clusters(spark, str(tmp_path / "c")).collect()] == [(3, 4)]
    tables.write_mers(spark.createDataFrame([("ACGT",)], "mer string"), str(tmp_path / "m"))
    assert "".join(open(x).read() for x in glob.glob(str(tmp_path / "m" / "part-*"))) == ">\nACGT\n"


def read(folder) -> list[str]:
    return [line for x in sorted(glob.glob(str(folder / "part-*"))) for line in open(x).read().splitlines()]


def test_result_writers(spark, tmp_path):
    sinks.histogram(spark.createDataFrame([(10, 2), (0, 5)], "bin int, count long"), str(tmp_path / "h"))
    assert read(tmp_path / "h") == ["bin,count", "0,5", "10,2"]
    sinks.merged(spark.createDataFrame([(0, 1, None)], "i long, a long, b long"), str(tmp_path / "m"))
    assert set(read(tmp_path / "m")) == {"i,a,b", "0,1,"}
    sinks.node_distances(spark.createDataFrame([(7, 2, 5)], "seq_id long, cluster int, hd long"), str(tmp_path / "d"))
    assert set(read(tmp_path / "d")) == {"seq_id,clu,HD", "7,2,5"}
    sinks.nearest(spark.createDataFrame([(1, 3.0), (2, 1.0)], "node int, dist double"), str(tmp_path / "n"))
    assert [x for x in read(tmp_path / "n") if x != "node,dist"] == ["2,1.0", "1,3.0"]
    sinks.stats(spark.createDataFrame([(1.5, 2.5)], "mean double, stdev double"), str(tmp_path / "s"))
    assert set(read(tmp_path / "s")) == {"mean\tstdev", "1.5\t2.5"}
    sinks.column(spark.createDataFrame([("a", 1)], "x string, y int"), "x", str(tmp_path / "col"))
    assert read(tmp_path / "col") == ["a"]


def test_node_tables(spark, tmp_path):
    tree = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 3)], "node int, parent int")
    got = {r["node"]: (r["level"], r["isBranch"]) for r in sinks.tree_levels(tree).collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (2, True), 4: (3, False)}
    sinks.tree_text(tree, str(tmp_path / "t"))
    assert read(tmp_path / "t") == [" 1 < 0", "  2 < 1", "  3 < 1", "   4 < 3"]
    sinks.node_table(tree, str(tmp_path / "csv"))
    assert sorted(x for x in read(tmp_path / "csv") if x[0].isdigit()) == ["1,0,1,true", "2,1,2,false", "3,1,2,true", "4,3,3,false"]
    sigs = spark.createDataFrame([(i, [i]) for i in range(1, 5)], "node int, bits array<int>")
    sinks.nodes(sigs, str(tmp_path / "p"))
    edges = tree.select("parent", F.col("node").alias("child"))
    assert {(r["parent"], r["node"], r["bits"][0]) for r in scans.node_signatures(edges, spark.read.parquet(str(tmp_path / "p"))).collect()} == {(0, 1, 1), (1, 2, 2), (1, 3, 3), (3, 4, 4)}


def test_folders_by_file_and_sequence(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, [1]), ("a", 1, [2]), ("b", 0, [3])], "file string, seq_id long, bits array<int>")
    sinks.by_file(df, str(tmp_path / "f"))
    assert sorted(os.path.basename(x) for x in glob.glob(str(tmp_path / "f" / "file=*"))) == ["file=a", "file=b"]
    sinks.by_sequence(df, str(tmp_path / "s"))
    assert all(len(glob.glob(f"{x}/part-*")) == 1 for x in glob.glob(str(tmp_path / "s" / "seq_id=*")))


def test_dumps(spark):
    r = spark.createDataFrame([([0, 3, 9],)], "bits array<int>").select(sinks.as_zeros_and_ones(F.col("bits"), 16).alias("z"), sinks.as_bytes(F.col("bits"), 16).alias("b"), sinks.as_list(F.col("bits")).alias("l")).first()
    assert (r["z"], r["b"], r["l"]) == ("1001000001000000", [9, 2], "0,3,9")


def test_sparse_records_and_splits(tmp_path):
    """Bits of sparse and full records are the same as by unpacking all bytes; small splits grow with the files, so tasks stay few."""
    import numpy as np

    from seqloom.sources import splits

    r = np.random.default_rng(3)
    data = np.where(r.random((50, 40)) < 0.1, r.integers(0, 256, (50, 40)), 0).astype(np.uint8)
    data[7], data[9] = 0, 255
    assert splits.bit_lists(data).to_pylist() == [np.flatnonzero(np.unpackbits(x, bitorder="little")).tolist() for x in data]
    assert splits.grown(1 << 18, 1 << 20) == 1 << 18 and splits.grown(1 << 18, 100 << 30) == splits.SPLIT
    path = tmp_path / "big.bin"
    with open(path, "wb") as f:
        f.truncate(1 << 30)
    assert len(splits.Reader([str(path)], 1 << 18).partitions()) <= splits.MANY + 1
