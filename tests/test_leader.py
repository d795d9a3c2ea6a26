"""Trees grown in batches against the plain fold, on data with branches."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import leader


def family(seed: int, n: int) -> dict[int, list[int]]:
    """Signatures in nested groups, so that nodes are adopted and entered."""
    r = random.Random(seed)
    out = {}
    for i in range(n):
        top, mid, low = r.randrange(3), r.randrange(3), r.randrange(3)
        bits = set(range(100 * top, 100 * top + 8)) | {100 * top + 10 * mid + 20 + b for b in range(5)} | {100 * top + 60 + 12 * mid + 4 * low + b for b in range(4)}
        bits = {b for b in bits if r.random() > 0.12} | {400 + r.randrange(60) for _ in range(r.randrange(4))}
        out[i] = sorted(bits)
    return out


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a & b else 0.0


def plain(data: dict[int, list[int]], stay: float, split: float, first: int, misfits: int, loosen: float = 0.0):
    """Batches as the module states them, by sets and lists: (members, parents, order of children)."""
    children, parent, members, sig, own = collections.defaultdict(list), {}, collections.defaultdict(list), {}, {}

    def likeness(node, bits):
        return jaccard(sig[node] if node in sig else own[node], bits)

    def way(bits):
        at, bound = 0, stay
        while True:
            like = {c: likeness(c, bits) for c in children[at]}
            for c in children[at]:
                if like[c] >= bound:
                    return "stay", c
            kin = [c for c in children[at] if like[c] > split]
            leaves, branches = [c for c in kin if not children[c]], [c for c in kin if children[c]]
            if not kin:
                return "leaf", at
            if len(leaves) == 1:
                at = leaves[0]
            elif len(branches) == 1:
                at = branches[0]
            else:
                return "gather", at, branches + leaves
            bound = max(bound - loosen, split + 1e-9) if loosen else bound

    todo, done, size, waiting, total = sorted(data), 0, first, [], len(data)
    while done < total or waiting:
        batch = waiting + todo[done : done + size]
        done = min(total, done + size)
        size = done
        ways = {i: way(set(data[i])) for i in batch}
        rest = [i for i in batch if ways[i][0] != "stay"]
        for i in batch:
            if ways[i][0] == "stay":
                members[ways[i][1]].append(i)
        for i in rest[:misfits]:
            kind, *where = way(set(data[i]))
            if kind == "stay":
                members[where[0]].append(i)
                continue
            node = len(parent) + 1
            parent[node] = where[0]
            own[node] = set(data[i])
            children[where[0]].append(node)
            members[node].append(i)
            if kind == "gather":
                children[where[0]] = [c for c in children[where[0]] if c not in where[1]]
                for c in where[1]:
                    children[node].append(c)
                    parent[c] = node
        waiting = rest[misfits:]
        for node, who in members.items():
            votes = collections.Counter(b for i in who for b in data[i])
            sig[node] = {b for b, n in votes.items() if n >= (len(who) + 1) // 2}
    return {i: n for n, who in members.items() for i in who}, parent, sig


@pytest.mark.parametrize("seed,first,misfits,loosen", [(2, 20, 12, 0.0), (3, 40, 4096, 0.1)])
def test_same_as_plain_batches(spark, seed, first, misfits, loosen):
    data = family(seed, 90) | {500: [], 501: []}
    df = spark.createDataFrame(list(data.items()), "seq_id long, bits array<int>").repartition(3)
    members, nodes, means = leader.grow(df, leader.Flat(512), 0.62, 0.2, loosen, first=first, misfits=misfits)
    want, parent, sig = plain(data, 0.62, 0.2, first, misfits, loosen)
    assert {r["seq_id"]: r["node"] for r in members.collect()} == want and members.count() == len(data)
    rows = nodes.collect()
    assert {r["node"]: r["parent"] for r in rows} == parent
    assert len({p for p in parent.values() if p}) > 3  # branches, some below others
    got = collections.defaultdict(set)
    for r in means.collect():
        got[r["node"]].add(r["bit"])
    assert got == {n: s for n, s in sig.items() if s}
    assert len({(r["parent"], r["place"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("method", ["matching", "local", "global"])
def test_windowed(spark, method):
    r = random.Random(5)
    base = [[[100 * g + 10 * w + b for b in range(4)] for w in range(2 + g)] for g in range(3)]
    data = {i: [sorted(set(w) - ({w[0]} if r.random() < 0.3 else set())) for w in base[i % 3]] for i in range(40)}
    df = spark.createDataFrame(list(data.items()), "seq_id long, bits array<array<int>>")
    members, nodes, _ = leader.grow(df, leader.Windowed(method, 2), 0.3, 0.05, first=20)
    got = {x["seq_id"]: x["node"] for x in members.collect()}
    assert set(got) == set(data) and all(got[i] == got[i % 3] for i in data) and len(set(got.values())) == 3
    assert {x["parent"] for x in nodes.collect()} == {0}


def test_order_and_empty(spark):
    df = spark.createDataFrame([], "seq_id long, bits array<int>")
    members, nodes, means = leader.grow(df, leader.Flat(64), 0.8, 0.5)
    assert members.count() == nodes.count() == means.count() == 0
    rows = spark.createDataFrame([(i % 5, i) for i in range(50)], "a long, b long").repartition(4)
    got = leader.ordered(rows, F.col("a"), F.col("b")).collect()
    assert [(x["a"], x["b"]) for x in sorted(got, key=lambda x: x["rank"])] == sorted((i % 5, i) for i in range(50))
    with pytest.raises(ValueError):
        leader.grow(df, leader.Flat(64), 0.2, 0.5)


def test_only_changed_nodes_are_packed_again(spark, monkeypatch):
    data, packed, compared = family(7, 60), [], []
    shelved, alike = leader.Flat.shelved, leader.Flat.alike
    monkeypatch.setattr(leader.Flat, "shelved", lambda self, means: packed.append(means.count()) or shelved(self, means))
    monkeypatch.setattr(leader.Flat, "alike", lambda self, items, *more: compared.append(items.count()) or alike(self, items, *more))
    df = spark.createDataFrame(list(data.items()), "seq_id long, bits array<int>")
    members, nodes, means = leader._grow(df, leader.Flat(512), 0.62, 0.2, first=20, misfits=20, fill=20)
    assert members.count() == 60 and members.select("seq_id").distinct().count() == 60
    assert means.count() == nodes.count() <= sum(packed) <= 60  # a state of a node is of members that came since
    assert sum(compared) <= 60 + 20  # few are compared with nodes twice


def test_reached():
    import pyarrow as pa

    rows = [(1, 5, 0), (1, 6, 5), (1, 7, 6), (1, 9, 8), (2, 6, 5), (2, None, None), (3, 8, 0), (3, 9, 8)]
    t = pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("seq_id", "node", "parent"), zip(*rows), strict=True)})
    assert leader._reached(t).tolist() == [0, 1, 2, 6, 7]
