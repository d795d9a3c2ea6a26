"""Near pairs by folded cells: all of them, few others, and nothing shuffled by bit."""

import random

import numpy as np
from test_block_shuffles import plan

from seqloom.operators import block_pairs, pairs


def rows_of(r: random.Random, n: int, size: int, span: int) -> list[list[int]]:
    own = [sorted(r.sample(range(span), r.randint(1, size))) for _ in range(n)]
    return own + [sorted(set(x) ^ set(r.sample(range(span), 3))) or [0] for x in own[::7]]


def packed(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([b for x in rows for b in x], np.int32), np.cumsum([0, *map(len, rows)])


def test_near_pairs_are_all_found_and_few_others_counted():
    r = random.Random(1)
    x, y = rows_of(r, 150, 90, 700), rows_of(r, 120, 90, 700)
    y += x[::9]
    m, n = (np.array([*map(len, z)]) for z in (x, y))
    inter = np.array([[len(set(a) & set(b)) for b in y] for a in x])
    assert (block_pairs.common(packed(x), packed(y)) == inter).all()
    for least in (0.5, 0.9):
        share = (1 - least) / (1 + least)
        a, b = block_pairs.close(packed(x), packed(y), share * m, share * n)
        want = {*zip(*np.nonzero(inter >= least * (m[:, None] + n[None, :] - inter)), strict=True)}
        assert want <= {*zip(a, b, strict=True)} and len(a) < len(want) + m.size * n.size / 50
        a, b, c = block_pairs.near(packed(x), packed(y), share * m, share * n)
        assert (c == inter[a, b]).all() and want <= {*zip(a, b, strict=True)}


def test_similar_pairs_are_not_shuffled_by_bit(spark):
    r = random.Random(2)
    rows = [*enumerate(rows_of(r, 40, 30, 200)), (99, [])]
    df = spark.createDataFrame(rows, "seq_id long, bits array<int>")
    for least in (0.5, 0.9):
        found = pairs.similar(df, least)
        assert "CartesianProduct" in plan(found) and "Exchange" not in plan(found)
        want = {(i, j) for i, x in rows for j, y in rows if i < j and x and len({*x} & {*y}) >= least * len({*x} | {*y})}
        assert want and {(p["i"], p["j"]) for p in found.collect()} == want


def test_pairs_apart_by_blocks_of_like_size(spark, monkeypatch):
    monkeypatch.setattr(block_pairs, "BLOCK", 5)
    r = random.Random(4)
    rows = [*enumerate(rows_of(r, 40, 30, 60))]
    found = block_pairs.apart(spark.createDataFrame(rows, "seq_id long, bits array<int>"), 4)
    assert "a_hi" in plan(found) and "Exchange" not in plan(found)
    want = {(i, j): len({*x} ^ {*y}) for i, x in rows for j, y in rows if i < j and len({*x} ^ {*y}) <= 4}
    assert want and {(p["i"], p["j"]): p["hd"] for p in found.collect()} == want


def test_like_siblings_take_signatures_a_row_each(spark):
    from seqloom.operators import trees

    r = random.Random(5)
    rows = [*enumerate(rows_of(r, 60, 6, 9)), (99, []), (98, [])]
    nodes = spark.createDataFrame([(i, i % 2) for i, _ in rows], "node long, parent long")
    lists = spark.createDataFrame(rows, "node long, bits array<int>")
    bits = spark.createDataFrame([(i, b) for i, x in rows for b in x], "node long, bit int")
    got = {(p["node"], p["into"]) for p in trees.like_siblings(nodes, lists, 3).collect()}
    assert got and got == {(p["node"], p["into"]) for p in trees.like_siblings(nodes, bits, 3).collect()}


def test_tenths_are_counted_without_a_share_for_each_pair(spark, monkeypatch):
    r = random.Random(6)
    rows = rows_of(r, 60, 12, 20) + [[1, 2], [1, 2], [3]]
    monkeypatch.setattr(block_pairs, "each_two", lambda signatures, function, schema, least=0.0: signatures.sparkSession.createDataFrame(function(*signatures).to_pandas(), schema))

    class Given(tuple):
        sparkSession = spark

    m = np.array([*map(len, rows)])
    inter = np.array([[len({*x} & {*y}) if i < j else -1 for j, y in enumerate(rows)] for i, x in enumerate(rows)], np.int32)
    monkeypatch.setattr(np, "floor", None)
    got = block_pairs.histogram(Given((np.arange(len(m)), m, np.arange(len(m)), m, inter))).collect()
    want = {10 * k: 0 for k in range(11)}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            want[10 * len({*x} & {*y}) // len({*x} | {*y}) * 10] += 1
    assert {p["bin"]: p["count"] for p in got} == want and min(want[0], want[100]) > 0
