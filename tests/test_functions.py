import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.config import SketchConfig, optimal_bits
from seqloom.functions import bloom, kmers, metrics
from seqloom.operators import aggregates, pairs, winnowing


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_golden_minimisers(spark):
    s = F.col("s")
    get = lambda seq, h: one(spark, kmers.minimiser_set(h, 5), s=seq)
    assert get("ACGGCGACGTTTAG", kmers.kmers(s, 4)) == [26, 27, 97]
    assert get("ACGGCGACGTTTAG", kmers.canonical_kmers(s, 4)) == [1, 6, 26, 27, 97]
    assert get("A" * 19, kmers.kmers(s, 4)) == [0]
    assert get("AC", kmers.kmers(s, 4)) == []


def test_emissions():
    assert [v for _, v in winnowing.emitted(winnowing.hashes("ACGGCGACGTTTAG", 4), 5)] == [26, 97, 27]
    assert [v for _, v in winnowing.emitted(winnowing.hashes("A" * 19, 4), 5)] == [0, 0, 0]
    assert [v for _, v in winnowing.emitted(winnowing.hashes("A" * 6, 4), 5)] == [0]
    r = random.Random(2)
    for _ in range(300):
        h = np.array([r.randrange(5) for _ in range(r.randrange(30))])
        w = r.randint(2, 6)
        sliding = {int(h[i : i + w].min()) for i in range(max(len(h) - w, 0) + 1)} if len(h) else set()
        assert {v for _, v in winnowing.emitted(h, w)} == sliding


def test_signature_sizes_and_bits(spark):
    assert [optimal_bits(n) for n in (50, 100, 1000, 10000)] == [720, 1440, 14384, 143776]
    for k in (9, 20):
        got = spark.range(6).select(bloom.bloom_bit(F.col("id"), 14384, k).alias("b")).collect()
        assert [r["b"] for r in got] == [3080, 9423, 3606, 205, 13460, 1291]


def test_window_counts(spark):
    n = lambda length: max(length - 9 + 1, 0)
    for length, want in ((200, 3), (50, 0), (51, 1), (0, 0)):
        assert one(spark, kmers.n_windows(F.col("n"), 42, 50), n=n(length)) == want
        assert one(spark, F.size(kmers.windows(kmers.kmers(F.col("s"), 9), 42, 50, 3)), s="ACGTTGCA" * 40 if length > 320 else ("ACGTTGCA" * 40)[:length]) == want


def test_parameters():
    for bad in ({"k": 60}, {"k": 9, "w": 8}, {"k": 9, "w": 10, "s": 3}, {"step": 0}):
        with pytest.raises(ValueError):
            SketchConfig(**bad)
    with pytest.raises(ValueError):
        optimal_bits(0)


def test_counts_metrics(spark):
    a, b, i = F.lit(3), F.lit(3), F.lit(2)
    assert one(spark, F.struct(metrics.union_size(a, b, i), metrics.hamming(a, b, i), metrics.jaccard(a, b, i)), x=1)[0:3] == (4, 2, 0.5)
    assert one(spark, metrics.jaccard(F.lit(0), F.lit(0), F.lit(0)), x=1) is None


def test_identical_small_windows_match(spark):
    rows = [(1, 0, 1), (1, 0, 2), (1, 1, 5), (2, 0, 1), (2, 0, 2), (2, 1, 6)]
    bits = spark.createDataFrame(rows, "seq_id long, window_id int, bit int")
    n = spark.createDataFrame([(1, 2), (2, 2)], "seq_id long, n long")
    assert pairs.matching_windows(bits, n, 4).first()["similarity"] == 0.5


def test_majority_ties(spark):
    rows = [(1, s, 0) for s in range(4)] + [(1, 0, 7), (1, 1, 7)]
    members = spark.createDataFrame(rows, "g long, seq_id long, bit int")
    assert {r["bit"] for r in aggregates.mean_signature(members, "majority", "g").collect()} == {0, 7}
    assert {r["bit"] for r in aggregates.mean_signature(members, "strict", "g").collect()} == {0}
    assert {r["bit"] for r in aggregates.mean_signature(members, "and", "g").collect()} == {0}


def test_histogram_bins(spark):
    sims = spark.createDataFrame([(x / 100,) for x in (0, 9.99, 10, 99.99, 100)], "similarity double")
    assert {r["bin"]: r["count"] for r in aggregates.histogram(spark, sims).collect() if r["count"]} == {0: 2, 10: 1, 90: 1, 100: 1}


def test_prefix_filter_finds_all(spark):
    r = random.Random(4)
    rows = [(i, sorted(r.sample(range(30), r.randint(0, 12)))) for i in range(60)]
    sigs = spark.createDataFrame(rows, "seq_id long, bits array<int>")
    want = {(i, j) for i, x in rows for j, y in rows if i < j and (x or y) and len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y))}
    assert {(p["i"], p["j"]) for p in pairs.similar(sigs, 0.5).collect()} == want


def test_treap_inserts_what_it_does_not_find(spark):
    """Sequences without an id that 26 divides find each other; with the reference's stride they match nothing."""
    from seqloom.operators.clustering import Treap, treap_classify

    rows = [(i, w, [100 * group + 10 * w + b for b in range(3)]) for i, group in ((0, 0), (1, 1), (2, 2), (3, 1), (27, 2), (53, 0)) for w in range(4)]
    df = spark.createDataFrame(rows, "seq_id long, window_id int, bits array<int>")
    got = {r["seq_id"]: r["cluster"] for r in treap_classify(df.select("seq_id").distinct(), df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1, 27: 2, 53: 0}
    none = Treap.NOT_FOUND
    assert {r["seq_id"]: r["cluster"] for r in treap_classify(df.select("seq_id").distinct(), df, stride=26).collect()} == {0: 0, 1: none, 2: none, 3: none, 27: none, 53: 0}


def test_pairs_of_blocks(spark, monkeypatch):
    """Many blocks, sizes that many rows share, and rows without bits, against all pairs."""
    from seqloom.operators import block_pairs

    monkeypatch.setattr(block_pairs, "BLOCK", 6)
    r = random.Random(6)
    rows = [(i, sorted(r.sample(range(70), r.choice([0, 3, 3, 3, 20, 40])))) for i in range(60)]
    df = spark.createDataFrame(rows, "seq_id long, bits array<int>")
    want = {}
    for i, x in rows:
        for j, y in rows:
            if i < j and set(x) & set(y):
                want[i, j] = (len(x), len(y), len(set(x) & set(y)))
    assert {(p["i"], p["j"]): (p["na"], p["nb"], p["inter"]) for p in block_pairs.counted(df).collect()} == want
    for least in (0.1, 0.5, 1.0):
        got = {(p["i"], p["j"]) for p in block_pairs.similar(df, least).collect()}
        assert got == {k for k, (a, b, c) in want.items() if c / (a + b - c) >= least}
    full = [i for i, x in rows if x]
    bins = {p["bin"]: p["count"] for p in block_pairs.histogram(df).collect()}
    assert sum(bins.values()) == len(full) * (len(full) - 1) // 2 and len(bins) == 11
    assert bins[100] == sum(c == a == b for a, b, c in want.values())
    assert block_pairs.counted(df.limit(0)).count() == 0


def test_batches_same_as_columns(spark):
    """Arrays of many sequences at once equal the column expressions of each: short, long and empty ones, both strands, seeds, long k."""
    import pyarrow as pa

    from seqloom.functions import batches
    from seqloom.operators import sketches

    r = random.Random(4)
    seqs = ["", "A", "ACGTACGTA", "A" * 120, *["".join(r.choice("ACGT") for _ in range(r.randrange(300))) for _ in range(12)]]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string").repartition(2)
    for cfg in (SketchConfig(), SketchConfig(k=9, w=9, s=1), SketchConfig(k=4, w=8, canonical=True), SketchConfig(k=20, w=30, s=2, step=7, seed=11), SketchConfig(k=7, w=20, canonical=True, seed=5)):
        h = sketches.hash_array(cfg)
        wins = kmers.windows(h, cfg.width, cfg.hop, cfg.s)
        chosen = h if cfg.k == cfg.w else kmers.minimiser_set(h, cfg.width)
        want = {x["seq_id"]: x for x in df.select("seq_id", h.alias("h"), wins.alias("w"), kmers.minimiser_set(h, cfg.width).alias("m"), bloom.bits_of(chosen, cfg.bits, cfg.k).alias("b"), F.transform(wins, lambda w: bloom.bits_of(w, cfg.bits, cfg.k)).alias("wb")).collect()}
        by_row = lambda rows, *c: sorted(tuple(x) for x in rows.select("seq_id", *c).collect())
        each = lambda name: sorted((i, p, v) for i, x in want.items() for p, v in enumerate(x[name]))
        assert by_row(sketches.kmer_rows(df, cfg), "pos", "h") == each("h")
        assert by_row(sketches.window_rows(df, cfg), "window_id", "hashes") == each("w")
        assert by_row(sketches.windowed(df, cfg), "window_id", "bits") == each("wb")
        assert by_row(sketches.flat(df, cfg), "bits") == sorted((i, x["b"]) for i, x in want.items())
        assert by_row(sketches.window_lists(df, cfg), "hashes") == sorted((i, [w[0] for w in x["w"]]) for i, x in want.items())
        if cfg.k < cfg.w:
            assert by_row(sketches.minimiser_rows(df, cfg), "h") == sorted((i, v) for i, x in want.items() for v in x["m"])
    with pytest.raises(ValueError):
        batches.hashes(pa.array(["ACN"]), SketchConfig())
    # a sliced array, a null, and slices that hold more than one row and less than all
    some = pa.array(["TT", "ACGTACGTAC", None, "ACGTACGTA"]).slice(1)
    assert batches.hashes(some, SketchConfig())[1].tolist() == [0, 2, 2, 3]
    assert batches.slices(pa.array(["A" * (batches.BASES // 2 - 1)] * 5 + ["", None])) == [(0, 2), (2, 4), (4, 7)]


def test_sequences_are_sketched_once(spark):
    """No filter before an explode evaluates the k-mers again, and none goes through interpreted lambdas."""
    from seqloom.operators import sketches

    df = spark.createDataFrame([(1, "ACGT" * 9)], "seq_id long, seq string")
    for rows in (sketches.bit_rows(sketches.flat(df, SketchConfig(k=9, w=9, s=1))), sketches.bit_rows(sketches.windowed(df, SketchConfig()))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "lambdafunction" not in plan


def test_compressed_and_emissions_in_slices(spark):
    from seqloom.operators import sketches

    sigs = spark.createDataFrame([(1, [1, 5001, 9999, 10001]), (2, []), (3, [4999, 5000])], "seq_id long, bits array<int>")
    assert sorted((x["seq_id"], x["bits"]) for x in sketches.compressed(sigs, [10000, 5000]).collect()) == [(1, [1, 4999]), (2, []), (3, [0, 4999])]
    assert "Exchange" not in sketches.compressed(sigs, [10000, 5000])._jdf.queryExecution().executedPlan().toString()
    r = random.Random(8)
    seqs = [*("".join(r.choice("ACGT") for _ in range(r.randrange(90))) for _ in range(30)), ""]
    got = [tuple(x) for x in winnowing.emissions(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"), 4, 5, most=100).collect()]  # several slices, some of one row
    assert sorted(got) == sorted((i, o, p, v) for i, s in enumerate(seqs) for o, (p, v) in enumerate(winnowing.emitted(winnowing.hashes(s, 4), 5)))


def test_bits_of_hash_lists(spark):
    from seqloom.operators import clustering

    data = {1: [5, 0, 1 << 40], 2: [], 3: [-1]}
    got = clustering.hash_bits(spark.createDataFrame(list(data.items()), "seq_id long, hashes array<bigint>"))
    assert {x["seq_id"]: x["bits"] for x in got.collect()} == {i: [64 * p + b for p, h in enumerate(hs) for b in range(64) if h >> b & 1] for i, hs in data.items()}
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()
