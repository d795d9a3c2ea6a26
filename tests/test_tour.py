"""Tours around trees and the nested text that they write, against plain walks."""

import glob
import json
import random
import sys

import pytest

from seqloom.operators.tour import tour
from seqloom.sources import sinks


def walk(parents):
    """node -> (parent, level, enters, leaves), without recursion."""
    below, out, at = {}, {}, 0
    for node, parent in sorted(parents.items()):
        below.setdefault(parent if parent in parents else None, []).append(node)
    stack = [(n, 1, False) for n in reversed(below.get(None, []))]
    while stack:
        node, level, left = stack.pop()
        if left:
            out[node] += (at,)
        else:
            out[node] = (parents[node] if parents[node] in parents else None, level, at)
            stack.append((node, level, True))
            stack += [(n, level + 1, False) for n in reversed(below.get(node, []))]
        at += 1
    return out


def forest(name):
    r = random.Random(5)
    return {
        "random": {i: r.randrange(-3, i) for i in range(300)},
        "chain": {i: i - 1 for i in range(1500)},
        "star": {i: 0 if i else None for i in range(400)},
        "cycle": {1: 2, 2: 1, 3: 2, 4: None, 5: 4},
        "empty": {},
    }[name]


@pytest.mark.parametrize("name", ["random", "chain", "star", "cycle", "empty"])
def test_tour_is_a_walk(spark, name):
    parents = forest(name)
    got = tour(spark.createDataFrame(list(parents.items()), "node long, parent long")).collect()
    assert {r["node"]: (r["parent"], r["level"], r["enters"], r["leaves"]) for r in got} == walk(parents)
    assert len(got) == (2 if name == "cycle" else len(parents))


@pytest.mark.parametrize("name", ["random", "chain", "empty"])
def test_json_parses_back(spark, tmp_path, name):
    parents, r = forest(name), random.Random(6)
    held = {n: sorted(r.sample(range(1000), r.choice([0, 1, 3, 4, 9]))) for n in parents}
    nodes = spark.createDataFrame([(n, p, n / 7) for n, p in parents.items()], "node long, parent long, priority double")
    members = spark.createDataFrame([(n, i) for n, ids in held.items() for i in ids], "node long, seq_id long")
    sinks.tree_json(nodes, members.unionByName(members), str(tmp_path / "t"), most=4)  # repeated rows count once
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/t/part-*")))
    assert text.startswith("var treeData = ")
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20000)
    try:
        root = json.loads(text[len("var treeData = ") :])
    finally:
        sys.setrecursionlimit(limit)
    found, stack = {}, [(c, None) for c in root["children"]]
    while stack:
        x, parent = stack.pop()
        n = int(x["node"])
        ids = [int(i) for i in x["content"][1:].replace(" ", "").split(",") if i]
        assert ids == held[n] and x["childCount"] == str(len(ids)) and x["priority"] == f"{n / 7:.2f}"
        found[n] = parent
        stack += [(c, n) for c in x["children"]]
        assert [int(c["node"]) for c in x["children"]] == sorted(int(c["node"]) for c in x["children"])
    assert found == {n: p if p in parents else None for n, p in parents.items()}


def test_names_are_quoted(spark, tmp_path):
    nodes = spark.createDataFrame([('a "b" \\', None, None)], "node string, parent string, priority double")
    sinks.tree_json(nodes, spark.createDataFrame([], "node string, seq_id long"), str(tmp_path / "t"))
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/t/part-*")))
    assert json.loads(text[len("var treeData = ") :])["children"][0]["node"] == 'a "b" \\'


def test_nothing_is_broadcast_but_rows(spark):
    """Events meet by merges: no round's table passes through the driver."""
    nodes = spark.range(1, 200).selectExpr("id AS node", "id div 2 AS parent")
    plan = tour(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan
