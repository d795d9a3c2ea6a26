"""Trees against plain Python, and the invariants of insertion and reassigning."""

import collections
import random

import pytest

from seqloom.operators import trees
from seqloom.operators.clustering import LeaderTree, WindowTree, Windows, alike


@pytest.fixture(scope="module")
def groups(spark):
    """Sixty sequences near one of four sets of bits, two without bits, and repeated ones."""
    r = random.Random(3)
    centres = [r.sample(range(256), 40) for _ in range(4)]
    rows = [(i, sorted(set(centres[i % 4][: 40 - i % 3]) | set(r.sample(range(256), i % 2)))) for i in range(60)]
    rows += [(60, []), (61, []), (62, rows[0][1]), (63, rows[0][1])]
    return spark.createDataFrame(rows, "seq_id long, bits array<int>"), dict(rows)


def found(df):
    rows = [(r["seq_id"], r["node"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("iterations", [0, 2])
def test_every_sequence_has_one_node(groups, iterations):
    df, rows = groups
    # centres are less alike than the split, so no group becomes a branch, which would take no member in a round
    members, nodes = trees.cluster(df, df, 256, 0.6, 0.3, iterations=iterations)
    got = found(members)
    assert set(got) == set(rows) and None not in got.values()
    assert set(got.values()) <= {r["node"] for r in nodes.collect()}
    if iterations:  # equal signatures share a node
        assert got[0] == got[62] == got[63]
        assert len({got[i] for i in range(60)}) == 4 and all(got[i] == got[i % 4] for i in range(60))


def test_order_and_cap(groups):
    df, rows = groups
    one = found(trees.cluster(df, df, 256, 0.6, 0.1, first=10)[0])
    assert {i for i, n in one.items() if n is not None} == set(range(10))
    two = found(trees.cluster(df, df, 256, 0.6, 0.1, first=10, seed=5)[0])
    assert sum(n is not None for n in two.values()) == 10
    again = found(trees.cluster(df, df, 256, 0.6, 0.1, first=10, seed=5, iterations=1)[0])
    assert None not in again.values()


def test_thresholds():
    own = [[1, 2], [7], [1, 2]]
    low, high = LeaderTree(64, 0.0, -0.1), LeaderTree(64, 1.5, 1.1)
    assert [low.insert(i, b) for i, b in enumerate(own)] == [1, 1, 1]
    assert [high.insert(i, b) for i, b in enumerate(own)] == [1, 2, 3] and high.parent == [-1, 0, 0, 0]
    with pytest.raises(ValueError):
        LeaderTree(64, 0.2, 0.3)
    # three of five bits common: enough at the second level only if stay loosens
    rows = [[1, 2, 3, 4], [1, 2, 5, 6], [1, 2, 5, 7]]
    strict, loose = LeaderTree(64, 0.8, 0.1), LeaderTree(64, 0.8, 0.1, loosen=0.3)
    assert [strict.insert(i, b) for i, b in enumerate(rows)][2] == 3
    assert [loose.insert(i, b) for i, b in enumerate(rows)][2] == 2


@pytest.mark.parametrize("method", ["matching", "local", "global"])
def test_windowed(spark, method):
    """Windowed trees: equal sequences share a node, strangers don't; joins give the similarities of the plain form."""
    r = random.Random(5)
    base = [[[100 * g + 10 * w + b for b in range(3)] for w in range(2 + g)] for g in range(3)]
    data = {i: [sorted(set(w) - ({w[0]} if r.random() < 0.3 else set())) for w in base[i % 3]] for i in range(18)}
    df = spark.createDataFrame([(i, w, b) for i, ws in data.items() for w, b in enumerate(ws)], "seq_id long, window_id int, bits array<int>")
    ids = spark.createDataFrame([(i,) for i in range(19)], "seq_id long")
    got = found(trees.cluster(df, ids, 0, 0.3, 0.05, iterations=1, method=method, threshold=2)[0])
    assert set(got) == set(range(19)) and len({got[i] for i in range(18)}) == 3 and all(got[i] == got[i % 3] for i in range(18))
    bits = df.selectExpr("seq_id", "window_id", "explode(bits) AS bit")
    of = bits.where("seq_id < 5").withColumnRenamed("seq_id", "node")
    like = {p["seq_id"]: (p["node"], p["similarity"]) for p in trees.most_alike_windowed(ids, bits, of, method, 2).collect()}
    for i, ws in data.items():
        best = max(((alike(Windows(data[n]), Windows(ws), method, 2), -n) for n in range(5)), default=None)
        assert like[i][0] == -best[1] and abs(like[i][1] - best[0]) < 1e-9
    assert like[18] == (None, None)
    tree = WindowTree(method, 2, 0.3, 0.05)
    assert [tree.insert(i, data[i % 3]) for i in range(6)] == [1, 2, 3, 1, 2, 3]


def test_unknown_method(spark):
    empty = spark.createDataFrame([], "seq_id long, window_id int, bit int")
    with pytest.raises(ValueError):
        trees.most_alike_windowed(empty, empty, empty.withColumnRenamed("seq_id", "node"), "none")


def test_ktree(spark):
    """Leaves hold the capacity at most, except for equal signatures; each sequence is in one."""
    r = random.Random(8)
    rows = {i: tuple(sorted(r.sample(range(40), r.randint(1, 9)))) for i in range(20)} | {i: (1, 2, 3) for i in range(20, 35)}
    bits = spark.createDataFrame([(i, b) for i, own in rows.items() for b in own], "seq_id long, bit int")
    members, nodes = trees.ktree(bits, 10, refine=1)
    got = found(members)
    assert set(got) == set(rows)
    leaves = collections.defaultdict(set)
    for i, n in got.items():
        leaves[n].add(rows[i])
    sizes = collections.Counter(got.values())
    assert all(n <= 10 or len(leaves[k]) == 1 for k, n in sizes.items())
    parents = {p["node"]: p["parent"] for p in nodes.collect()}
    assert set(sizes) <= set(parents) and all(k == "r" or parents[k] == k[:-1] for k in parents)
    nothing, root = trees.ktree(bits.limit(0), 10)
    assert nothing.count() == 0 and root.count() == 0


def _trimmed(parent: dict, filled: set) -> dict:
    kept = set()
    for n in filled & set(parent):
        while n in parent and n not in kept:
            kept.add(n)
            n = parent[n]
    kids = collections.Counter(parent[n] for n in kept)
    gone = {n for n in kept if kids[n] == 1 and n not in filled}
    out = {}
    for n in kept - gone:
        p = parent[n]
        while p in gone:
            p = parent[p]
        out[n] = p
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trim(spark, seed):
    r = random.Random(seed)
    # chains as well as branches
    parent = {n: (n - 1 if seed == 1 or r.random() < 0.6 else r.randrange(n)) for n in range(1, 24)}
    filled = set(r.sample(range(1, 24), 4)) | {99}
    nodes = spark.createDataFrame(list(parent.items()), "node long, parent long")
    got = {p["node"]: p["parent"] for p in trees.trim(nodes, spark.createDataFrame([(n,) for n in filled], "node long")).collect()}
    assert got == _trimmed(parent, filled)
    assert trees.trim(nodes, nodes.select("node").limit(0)).count() == 0


def test_descent_and_centroids(spark):
    """Two levels by hand: an ambiguous leaf has no vote; an empty sequence goes to the child of fewest bits."""
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 1)], "node long, parent long")
    own = {(3, 10): {1, 2}, (3, 11): {1, 2}, (4, 12): {1, 5}, (4, 13): {1, 5}, (5, 14): {9}, (2, 15): {7, 8}, (2, 16): {7}}
    members = spark.createDataFrame([(n, i, b) for (n, i), bits in own.items() for b in bits], "node long, seq_id long, bit int")
    means = trees.centroids(nodes, members)
    got = collections.defaultdict(set)
    for p in means.collect():
        got[p["node"]].add(p["bit"])
    assert got == {3: {1, 2}, 4: {1, 5}, 5: {9}, 2: {7, 8}, 1: {1, 2, 5}, 0: {1, 2, 5, 7, 8}}
    ids = spark.createDataFrame([(i,) for i in (*range(10, 17), 20)], "seq_id long")
    to = {p["seq_id"]: (p["node"], p["hd"]) for p in trees.descend(ids, members.select("seq_id", "bit"), nodes, means).collect()}
    assert to[10] == to[11] == (3, 0) and to[12] == to[13] == (4, 0) and to[15] == (2, 0) and to[16] == (2, 1)
    assert to[20] == (2, 2) and to[14] == (2, 3)


def test_search_with_look_ahead(spark):
    """A beam of one is the plain descent; a beam of all nodes is the scan of all leaves."""
    r = random.Random(2)
    nodes = spark.createDataFrame([(1, 0), (2, 0), *[(10 + i, 1 + i % 2) for i in range(6)]], "node long, parent long")
    own = {10 + i: {r.randrange(25) for _ in range(6)} for i in range(6)}
    own |= {p: set().union(*(own[10 + i] for i in range(6) if 1 + i % 2 == p)) for p in (1, 2)}
    means = spark.createDataFrame([(n, b) for n, bits in own.items() for b in bits], "node long, bit int")
    seqs = {i: {r.randrange(25) for _ in range(5)} for i in range(30)} | {99: set()}
    ids = spark.createDataFrame([(i,) for i in seqs], "seq_id long")
    bits = spark.createDataFrame([(i, b) for i, own_ in seqs.items() for b in own_], "seq_id long, bit int")
    rows = lambda df: {p["seq_id"]: (p["node"], p["hd"]) for p in df.collect()}
    assert rows(trees.search(ids, bits, nodes, means, 1)) == rows(trees.descend(ids, bits, nodes, means))
    want = {i: min((len(s ^ own[n]), n) for n in own if n >= 10) for i, s in seqs.items()}
    full, two = rows(trees.search(ids, bits, nodes, means, 8)), rows(trees.search(ids, bits, nodes, means, 2))
    assert full == {i: (n, hd) for i, (hd, n) in want.items()}
    assert sum(two[i] == full[i] for i in seqs) >= 0.8 * len(seqs) and all(two[i][1] >= full[i][1] for i in seqs)


def test_by_frequency(spark):
    """The shape stays, each node is there once, and no path gets more frequent downwards; ties stay."""
    r = random.Random(4)
    parent = {n: r.randrange(n) for n in range(1, 25)}
    n = {i: r.randrange(5) for i in range(1, 22)}
    got = {p["node"]: (p["parent"], p["n"]) for p in trees.by_frequency(spark.createDataFrame(list(parent.items()), "node long, parent long"), spark.createDataFrame(list(n.items()), "node long, n long")).collect()}
    assert set(got) == set(parent) and all(k == n.get(i, 0) for i, (_, k) in got.items())
    assert all(p not in got or got[p][1] >= k for p, k in got.values())
    assert sorted(collections.Counter(p for p, _ in got.values() if p).values()) == sorted(collections.Counter(p for p in parent.values() if p).values())


def test_super_clusters_of_long_chains(spark):
    parent = {i: i - 1 for i in range(1, 1000)} | {2000: 1, 2001: 2000, 3000: -5, 3001: 3000}
    got = {p["node"]: p["top"] for p in trees.super_clusters(spark.createDataFrame(list(parent.items()), "node long, parent long")).collect()}
    assert got == {i: 3000 if i >= 3000 else 1 for i in parent}


def test_like_siblings(spark):
    """As one child after another would merge, and what hung below merged ones is taken over."""
    r = random.Random(7)
    own = {i: {40 * (i % 3) + b for b in range(10) if r.random() > 0.15} for i in range(1, 31)} | {40: set(), 41: set(), 43: set()}
    own |= {50 + i: own[1 + i] for i in range(8)}
    parent = {i: 100 + i % 2 for i in own}
    kept, want = [], {}
    for i in sorted(own):
        into = next((k for k in kept if parent[k] == parent[i] and len(own[k] ^ own[i]) < 4), None)
        if into is None:
            kept.append(i)
        else:
            want[i] = into
    nodes = spark.createDataFrame(list(parent.items()) + [(200 + i, i) for i in own], "node long, parent long")
    means = spark.createDataFrame([(i, b) for i, bits in own.items() for b in bits] + [(200 + i, 900 + 7 * i + b) for i in own for b in range(5)], "node long, bit int")
    merged = trees.like_siblings(nodes, means, 4)
    assert {p["node"]: p["into"] for p in merged.collect()} == want and len(want) > 5
    members = spark.createDataFrame([(i, i) for i in own], "seq_id long, node long")
    left, moved = trees.contracted(nodes, members, merged)
    assert {p["seq_id"]: p["node"] for p in moved.collect()} == {i: want.get(i, i) for i in own}
    assert {p["node"]: p["parent"] for p in left.collect()} == {i: p for i, p in parent.items() if i not in want} | {200 + i: want.get(i, i) for i in own}
