import pytest
from pyspark.sql import functions as F

from seqloom.operators import clustering, leader
from seqloom.sources import scans, sequences, sinks, tables


def test_sequence_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nAC\n>two\n\n>three\nT\n")
    (tmp_path / "b.fq").write_text("@q1\nACGT\n+\n@III\n@q2\nGG\n+\nII\n")
    (tmp_path / "c.gb").write_text("LOCUS G1 8 bp\nORIGIN\n 1 acgt acgt\n//\n")
    (tmp_path / "d.em").write_text("ID E1; SV 1;\nSQ Sequence 4 BP;\n acgt 4\n//\n")
    rows = {(r["file"][-4:], r["seq_id"], r["id"], r["seq"]) for r in sequences.read(spark, str(tmp_path)).collect()}
    assert rows == {("a.fa", 0, "one x", "ACGTAC"), ("a.fa", 1, "two", ""), ("a.fa", 2, "three", "T"), ("b.fq", 0, "q1", "ACGT"), ("b.fq", 1, "q2", "GG"), ("c.gb", 0, "G1", "acgtacgt"), ("d.em", 0, "E1", "acgt")}
    assert {(r["id"], r["seq"]) for r in sequences.fasta(spark, str(tmp_path / "a.fa")).collect()} == {("one x", "ACGTAC"), ("two", ""), ("three", "T")}
    spark.dataSource.register(sequences.SequenceSource)
    assert spark.read.format("sequences").option("paths", str(tmp_path / "a.fa")).load().count() == 3
    assert sequences.listing(spark, str(tmp_path), "*.fa").count() == 1


def test_signature_round_trip(spark, tmp_path):
    rows = [(i, [i, 8 + i]) for i in range(5)]
    df = spark.createDataFrame(rows, "seq_id long, bits array<int>")
    sinks.signatures(df, 32, str(tmp_path / "flat"))
    got = scans.flat(spark, str(tmp_path / "flat")).collect()
    assert sorted(r["bits"] for r in got) == [b for _, b in rows]
    w = spark.createDataFrame([(0, 0, [1]), (0, 1, [2]), (1, 0, [3])], "seq_id long, window_id int, bits array<int>")
    sinks.windowed_signatures(w, 16, str(tmp_path / "win"))
    assert sorted((r["window_id"], r["bits"]) for r in scans.windowed(spark, str(tmp_path / "win")).collect()) == [(0, [1]), (0, [3]), (1, [2])]
    end = (1 << 64) - 1
    (tmp_path / "h.bin").write_bytes(b"".join(x.to_bytes(8, "little") for x in (5, 6, end, end, 7, end)))
    assert [r["hashes"] for r in scans.hash_lists(spark, str(tmp_path / "h.bin")).orderBy("seq_id").collect()] == [[5, 6], [], [7]]


def test_tables(spark, tmp_path):
    c = spark.createDataFrame([(0, 3), (1, 4)], "i long, count long")
    tables.write_counts(c.coalesce(1), str(tmp_path / "c"))
    (tmp_path / "config.csv").write_text(f"a,{tmp_path}/c\nb,{tmp_path}/c\n")
    assert sorted(map(tuple, tables.merged(spark, str(tmp_path / "config.csv")).collect())) == [(0, 3, 3), (1, 4, 4)]
    (tmp_path / "s.csv").write_text("junk\nmore\na,b\n1,2\n3,4\n")
    assert [r.asDict() for r in tables.skipping(spark, str(tmp_path / "s.csv"), 2).collect()] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    (tmp_path / "q.csv").write_text('junk\nid|"a name"|n\n1|"x|y, z"|3\n2||4\n')
    assert [tuple(r) for r in tables.skipping(spark, str(tmp_path / "q.csv"), 1, sep="|").collect()] == [("1", "x|y, z", "3"), ("2", None, "4")]
    (tmp_path / "tree.txt").write_text(tables.write_tree([(1, 0, 0.5, "b"), (2, 1, 0.25, "l"), (3, 1, 1, "l")], 90))
    assert {(r["parent"], r["child"]) for r in tables.tree(spark, str(tmp_path / "tree.txt")).collect()} == {(0, 1), (1, 2), (1, 3)}
    (tmp_path / "x.sbt").write_text("root\n*a\n**b\n**c\n*d\n")
    assert [(r["depth"], r["name"], r["parent"]) for r in tables.sbt(spark, str(tmp_path / "x.sbt")).orderBy("line_no").collect()] == [(0, "root", None), (1, "a", 0), (2, "b", 1), (2, "c", 1), (1, "d", 0)]


def test_leader_tree():
    sigs = [[0, 1, 2, 3], [0, 1, 2, 3], [0, 1, 2, 9], [20, 21]]
    tree = clustering.LeaderTree(64, 0.8, 0.3)
    nodes = [tree.insert(i, s) for i, s in enumerate(sigs)]
    assert nodes[0] == nodes[1] and len(set(nodes)) == 3
    assert sorted(i for m in tree.members for i in m) == [0, 1, 2, 3]
    all_apart = clustering.LeaderTree(64, 1.5, 1.0)
    assert len({all_apart.insert(i, s) for i, s in enumerate(sigs)}) == 4
    with pytest.raises(ValueError):
        clustering.LeaderTree(64, 0.2, 0.5)


def test_equal_sequences_share_a_node(spark):
    sigs = spark.createDataFrame([(i, [i % 3, 10 + i % 3, 20]) for i in range(12)], "seq_id long, bits array<int>")
    nodes = leader.leader_tree(sigs, 64, 0.6, 0.1).select("node", "bits")
    got = clustering.reinsert(sigs, nodes, 2).collect()
    assert len(got) == 12
    for k in range(3):
        assert len({r["cluster"] for r in got if r["seq_id"] % 3 == k}) == 1


def test_stream_assignment(spark, tmp_path):
    from seqloom.config import SketchConfig
    from seqloom.operators import sketches
    from seqloom.streaming.assign import assign_stream

    cfg = SketchConfig(k=4, w=4, s=1, n_elements=50)
    seqs = spark.createDataFrame([(0, "ACGTACGTTT"), (1, "GGGGCCCCAA")], "seq_id long, seq string")
    seqs.write.parquet(str(tmp_path / "in"))
    nodes = sketches.flat(seqs, cfg).select(F.col("seq_id").cast("int").alias("node"), "bits")
    stream = spark.readStream.schema(seqs.schema).parquet(str(tmp_path / "in"))
    q = assign_stream(stream, nodes, cfg, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {(r["seq_id"], r["cluster"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, 0), (1, 1)}
