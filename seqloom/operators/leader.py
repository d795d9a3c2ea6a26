"""Insertion trees grown in batches.

The rule is that of clustering.LeaderTree: children are asked in order, the first at least `stay` alike keeps a sequence; one that is
more than `split` alike is kin; a single kin leaf is entered, else a single kin branch; several are gathered under a new branch; with no kin
a new leaf is made. Here nodes' signatures hold still for a batch. A batch's sequences are compared with all nodes at once, block by
block; those that stay in the tree as it is join their nodes; the rest are inserted one after another by the same rule, among what they
themselves make; then nodes take their members' majorities. Batches double, but hold no more than one task of insertions will take at
the last batch's share of sequences that stay nowhere: where most stay, their number is the logarithm of the table's size. A batch of one sequence
is the plain insertion.

A node's signature is made anew only when it got members, and packed once: each state of a node has a stamp, and what was found for an older one is
dropped. So a batch costs its comparisons and the members of the nodes that changed.

Only the ones that stay nowhere go to one task, with the nodes they may meet: those all of whose ancestors are kin. It takes `MISFITS`
of them and `MET` met nodes at most; the others wait for the next batch, in order. Sequences without bits are like none: a leaf each.
Empty tables give empty ones.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.storage import written
from . import aggregates, block_pairs, clustering, windowed

#: Sequences of the first batch; sequences and met nodes of one task of insertions at most; sequences of a task of descents.
FIRST, MISFITS, MET, DESCENTS = 64, 4096, 2_000_000, 64
#: A stamp is a node's number times STAMPS and the batch that its signature is of.
ROOT, STAMPS = 0, 1 << 20


def ordered(rows: DataFrame, *by: Column) -> DataFrame:
    """rows with their number `rank` in an order, from 0: counted by partitions of ranges, whose sizes are summed up."""
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


class Packed:
    """Flat signatures as rows of one matrix of 64-bit words, all compared with another at once."""

    def __init__(self, bits: int):
        self.rows, self.sizes, self.n = np.zeros((64, -(-bits // 64)), np.uint64), np.zeros(64, np.int64), 0

    def described(self, bits: list[int]) -> tuple[np.ndarray, int]:
        out = np.zeros(self.rows.shape[1] * 64, np.uint8)
        out[bits] = 1
        return np.packbits(out, bitorder="little").view(np.uint64), len(bits)

    def add(self, own: tuple[np.ndarray, int]) -> None:
        if self.n == len(self.rows):
            self.rows, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.rows, self.sizes))
        self.rows[self.n], self.sizes[self.n] = own
        self.n += 1

    def within(self, own: tuple[np.ndarray, int], reach: list[float]) -> list[tuple[int, int]]:
        """(place, Hamming distance) of rows as near as each one's reach; sizes that are farther apart are not compared."""
        reach = np.asarray(reach)
        near = np.flatnonzero(np.abs(self.sizes[: self.n] - own[1]) <= reach)
        hd = np.bitwise_count(self.rows[near] ^ own[0]).sum(1, dtype=np.int64)
        here = hd <= reach[near]
        return list(zip(near[here].tolist(), hd[here].tolist(), strict=True))

    def likeness(self, own: tuple[np.ndarray, int]) -> np.ndarray:
        both = np.bitwise_count(self.rows[: self.n] & own[0]).sum(1, dtype=np.int64)
        return both / np.maximum(self.sizes[: self.n] + own[1] - both, 1)


class Listed:
    """Windowed signatures, compared one by one."""

    def __init__(self, method: str, threshold: int):
        self.method, self.threshold, self.rows = method, threshold, []

    def described(self, windows: list[list[int]]) -> clustering.Windows:
        return clustering.Windows(windows)

    def add(self, own: clustering.Windows) -> None:
        self.rows.append(own)

    def likeness(self, own: clustering.Windows) -> np.ndarray:
        return np.array([clustering.alike(x, own, self.method, self.threshold) for x in self.rows])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Flat:
    """Flat signatures (seq_id, bits) by Jaccard."""

    bits: int

    def alike(self, items: DataFrame, shelves: list[DataFrame], least: float) -> DataFrame:
        found = block_pairs.against(block_pairs.side(items, "seq_id"), _union(shelves), least)
        return found.withColumnRenamed("node", "stamp")

    def means(self, inside: DataFrame) -> DataFrame:
        """(stamp, bits) of members (stamp, seq_id, bits); a single member's is its own."""
        full = inside.where(F.size("bits") > 0)
        sized = full.join(full.groupBy("stamp").agg(F.count(F.lit(1)).alias("n")), "stamp")
        alone = sized.where("n = 1").select("stamp", F.array_sort(F.array_distinct("bits")).alias("bits"))
        many = aggregates.mean_signature(sized.where("n > 1").select("stamp", "seq_id", F.explode("bits").alias("bit")), "majority", "stamp")
        return alone.unionByName(many.groupBy("stamp").agg(F.array_sort(F.collect_list("bit")).alias("bits")))

    def shelved(self, means: DataFrame) -> DataFrame:
        return block_pairs.side(means, "stamp")

    def bit_rows(self, means: DataFrame) -> DataFrame:
        return means.select("node", F.explode("bits").alias("bit"))

    def shelf(self) -> Packed:
        return Packed(self.bits)


@dataclass
class Windowed:
    """Windowed signatures (seq_id, bits: an array a window), by one of windowed.METHODS."""

    method: str
    threshold: int

    def alike(self, items: DataFrame, shelves: list[DataFrame], least: float) -> DataFrame:
        from .trees import similarities

        found = similarities(self.rows(items, "seq_id"), _union(shelves).withColumnRenamed("stamp", "node"), self.method, self.threshold)
        return found.where(F.col("similarity") > least).select("seq_id", F.col("node").alias("stamp"), F.col("similarity").alias("alike"))

    def rows(self, items: DataFrame, *by: str) -> DataFrame:
        return items.select(*by, F.posexplode("bits").alias("window_id", "own")).select(*by, "window_id", F.explode("own").alias("bit"))

    def means(self, inside: DataFrame) -> DataFrame:
        """(stamp, window_id, bit) of members (stamp, seq_id, bits)."""
        return windowed.truncated_mean(self.rows(inside, "stamp", "seq_id"), "stamp")

    def shelved(self, means: DataFrame) -> DataFrame:
        return means

    def bit_rows(self, means: DataFrame) -> DataFrame:
        return means.select("node", "window_id", "bit")

    def shelf(self) -> Listed:
        return Listed(self.method, self.threshold)


@dataclass
class Rule:
    stay: float
    split: float
    loosen: float = 0.0

    def way(self, kin: Callable[[int], list[tuple]]) -> tuple:
        """("stay", node), ("leaf", parent) or ("gather", parent, nodes), given each node's kin children (place, node, branch, alike) in order."""
        at, stay = ROOT, self.stay
        while True:
            below = kin(at)
            for _, node, _, alike in below:
                if alike >= stay:
                    return "stay", node
            leaves, branches = ([x[1] for x in below if x[2] == which] for which in (False, True))
            if not below:
                return "leaf", at
            if len(leaves) == 1:
                at = leaves[0]
            elif len(branches) == 1:
                at = branches[0]
            else:
                return "gather", at, branches + leaves
            stay = max(stay - self.loosen, self.split + 1e-9) if self.loosen else stay


@dataclass
class Made:
    """What one task of insertions makes of the tree."""

    rule: Rule
    shelf: Packed | Listed
    next_node: int
    next_place: int
    members: list[tuple] = field(default_factory=list)
    nodes: dict[int, tuple[int, int]] = field(default_factory=dict)  # new and moved ones: (parent, place)
    branches: set[int] = field(default_factory=set)
    new: list[int] = field(default_factory=list)  # those whose signatures are on the shelf, in its order

    def node(self, parent: int, signature) -> int:
        node, self.next_node = self.next_node, self.next_node + 1
        self.put(node, parent)
        self.shelf.add(signature)
        self.new.append(node)
        return node

    def put(self, node: int, parent: int) -> None:
        self.nodes[node] = (parent, self.next_place)
        self.branches.add(parent)
        self.next_place += 1

    def insert(self, seq_id, bits: list, met: list[dict]) -> None:
        """met: node, parent, place, branch and likeness of the kin nodes that were there before."""
        signature, below = self.shelf.described(bits), defaultdict(list)
        for x in met:
            parent, place = self.nodes.get(x["node"], (x["parent"], x["place"]))
            below[parent].append((place, x["node"], x["branch"] or x["node"] in self.branches, x["alike"]))
        if self.new:
            alike = self.shelf.likeness(signature)
            for i in np.flatnonzero(alike > self.rule.split).tolist():
                parent, place = self.nodes[self.new[i]]
                below[parent].append((place, self.new[i], self.new[i] in self.branches, float(alike[i])))
        kind, *where = self.rule.way(lambda at: sorted(below[at]))
        node = where[0] if kind == "stay" else self.node(where[0], signature)
        for kin in where[1] if kind == "gather" else ():
            self.put(kin, node)
        self.members.append((seq_id, node))


MET_ROWS = "array<struct<node:bigint,parent:bigint,place:bigint,branch:boolean,alike:double>>"
_met = pa.list_(pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("place", pa.int64()), ("branch", pa.bool_()), ("alike", pa.float64())]))


def _reached(t: pa.Table) -> np.ndarray:
    """Places of the rows whose ancestors are all kin of the same sequence; steps upwards double."""
    at = np.flatnonzero(t["node"].is_valid().to_numpy())
    if not len(at):
        return at
    node, parent = (t[c].to_numpy()[at].astype(np.int64) for c in ("node", "parent"))
    code = np.unique(t["seq_id"].to_numpy()[at], return_inverse=True)[1] * (int(max(node.max(), parent.max())) + 1)
    order = np.argsort(code + node)
    keys = (code + node)[order]
    place = np.minimum(np.searchsorted(keys, code + parent), len(keys) - 1)
    root, gone = -1, -2
    up = np.where(parent == ROOT, root, np.where(keys[place] == code + parent, order[place], gone))
    while len(on := np.flatnonzero(up >= 0)):
        up[on] = up[up[on]]
    return at[up == root]


def _descend(rule: Rule):
    """Where sequences stay in the tree as it is; null, and the nodes whose ancestors are all kin, for those that stay nowhere."""

    def run(t: pa.Table) -> pa.Table:
        below: dict = defaultdict(lambda: defaultdict(list))
        ids, first = np.unique(t["seq_id"].to_numpy(), return_index=True)
        ranks = dict(zip(ids.tolist(), t["rank"].to_numpy()[first].tolist(), strict=True))
        kept = t.take(pa.array(_reached(t)))
        for i, node, parent, place, branch, alike in zip(*(kept[c].to_pylist() for c in ("seq_id", "node", "parent", "place", "branch", "alike")), strict=True):
            below[i][parent].append((place, node, branch, alike))
        rows = []
        for i, rank in ranks.items():
            kin = below[i]
            kind, node, *_ = rule.way(lambda at, kin=kin: sorted(kin[at]))
            met, todo = [], [ROOT] if kind != "stay" else []
            while todo:
                at = todo.pop()
                for place, child, branch, alike in kin[at]:
                    met.append({"node": child, "parent": at, "place": place, "branch": branch, "alike": alike})
                    todo.append(child)
            rows.append((i, rank, node if kind == "stay" else None, met))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), _met), strict=True)], names=["seq_id", "rank", "node", "met"])

    return run


def _insert(rule: Rule, kind: Flat | Windowed, next_node: int, next_place: int):
    """(seq_id, node) of sequences inserted in order of rank, and (node, parent, place) of nodes made or moved."""

    def run(t: pa.Table) -> pa.Table:
        tree = Made(rule, kind.shelf(), next_node, next_place)
        ids, bits, met = (t[c].to_pylist() for c in ("seq_id", "bits", "met"))
        for i in np.argsort(t["rank"].to_numpy(), kind="stable").tolist():
            tree.insert(ids[i], bits[i], met[i])
        rows = [(i, n, None, None) for i, n in tree.members] + [(None, n, p, at) for n, (p, at) in tree.nodes.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["seq_id", "node", "parent", "place"])

    return run


def grow(signatures: DataFrame, kind: Flat | Windowed, stay: float, split: float, loosen: float = 0.0, order: list[Column] | None = None, first: int = FIRST, misfits: int = MISFITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((seq_id, node), (node, parent, place), means): a tree over all signatures (seq_id, bits), grown in batches.

    The root is 0 and no row; a node's children are in order of place. means: (node, bit), and window_id for windowed ones.
    """
    if not 0 <= split < stay:
        raise ValueError("0 <= split < stay")
    members, nodes, means = _grow(signatures, kind, stay, split, loosen, order, first, misfits)
    return members, nodes, kind.bit_rows(means)


def _grow(signatures: DataFrame, kind: Flat | Windowed, stay: float, split: float, loosen: float = 0.0, order: list[Column] | None = None, first: int = FIRST, misfits: int = MISFITS, fill: int = MISFITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """grow, with means as their kind has them; a batch is to leave about `fill` sequences to the task of insertions."""
    rule, spark = Rule(stay, split, loosen), signatures.sparkSession
    ranked = written(ordered(signatures.select("seq_id", "bits"), *(order or []), F.col("seq_id")), "ranked")
    total, done, size = ranked.count(), 0, first
    members = spark.createDataFrame([], "seq_id long, node long")
    nodes = spark.createDataFrame([], "node long, parent long, place long, stamp long")
    states, shelves = [kind.means(ranked.limit(0).withColumn("stamp", F.lit(0).cast("long")))], []
    waiting, left, n_nodes, n_places, turn = None, 0, 0, 0, 0
    while done < total or left:
        turn += 1
        batch = ranked.where((F.col("rank") >= done) & (F.col("rank") < done + size)).select("seq_id", "bits", "rank")
        batch = written(batch if waiting is None else batch.unionByName(waiting), "batch")
        many = min(size, total - done) + left
        done = min(total, done + size)
        branch = nodes.select(F.col("parent").alias("node"), F.lit(True).alias("branch")).distinct()
        known = nodes.join(branch, "node", "left").withColumn("branch", F.coalesce("branch", F.lit(False)))
        # where nothing can be met yet, nothing is compared
        met = kind.alike(batch, shelves, split) if shelves else spark.createDataFrame([], "seq_id long, stamp long, alike double")
        some = F.pmod(F.xxhash64("seq_id"), F.lit(max(1, -(-many // DESCENTS))))
        way = batch.select("seq_id", "rank").join(met.join(known, "stamp").drop("stamp"), "seq_id", "left").withColumn("some", some)
        found = written(way.groupBy("some").applyInArrow(_descend(rule), f"seq_id long, rank long, node long, met {MET_ROWS}"), "found")
        rest = found.where("node IS NULL")
        # as many as one task may hold, in order; the first one in any case
        few = rest.select("rank", F.size("met").alias("n")).orderBy("rank").limit(misfits)
        held = few.select("rank", F.sum("n").over(Window.orderBy("rank")).alias("held"))
        counts = held.agg(F.max(F.when(F.col("held") <= MET, F.col("rank"))).alias("last"), F.min("rank").alias("least")).crossJoin(rest.agg(F.count(F.lit(1)).alias("n"))).first()
        last = counts["least"] if counts["last"] is None else counts["last"]
        joined, placed = found.where("node IS NOT NULL").select("seq_id", "node"), nodes.drop("stamp")
        waiting, left = None, 0
        if last is not None:
            task = rest.where(F.col("rank") <= last).join(batch.select("seq_id", "bits"), "seq_id").withColumn("one", F.lit(0))
            made = written(task.groupBy("one").applyInArrow(_insert(rule, kind, n_nodes + 1, n_places), "seq_id long, node long, parent long, place long"), "made")
            changed = made.where("seq_id IS NULL").select("node", "parent", "place")
            placed = placed.join(changed.select("node"), "node", "left_anti").unionByName(changed)
            joined = joined.unionByName(made.where("seq_id IS NOT NULL").select("seq_id", "node"))
            top = made.agg(F.max("node").alias("node"), F.max("place").alias("place"), F.count("seq_id").alias("n")).first()
            n_nodes, n_places = max(n_nodes, top["node"]), max(n_places, (top["place"] if top["place"] is not None else -1) + 1)
            left = counts["n"] - top["n"]
            waiting = batch.join(rest.where(F.col("rank") > last).select("seq_id"), "seq_id", "left_semi") if left else None
        # as large as all before it, and what waits is among the next task's already
        size = min(done, max(1, fill * many // max(counts["n"], 1) - left))
        got = joined.select("node", (F.col("node") * STAMPS + turn).alias("new")).distinct()
        stamped = placed.join(nodes.select("node", "stamp"), "node", "left").join(got, "node", "left")
        nodes = written(stamped.select("node", "parent", "place", F.coalesce("new", "stamp").alias("stamp")), "nodes")
        members = written(members.unionByName(joined), "members")
        inside = members.join(nodes.where(F.pmod("stamp", F.lit(STAMPS)) == turn).select("node", "stamp"), "node")
        inside = written(inside.join(ranked.select("seq_id", "bits"), "seq_id").select("stamp", "seq_id", "bits"), "inside")
        states.append(written(kind.means(inside), "means"))
        shelves.append(kind.shelved(states[-1]))
    return members, nodes.drop("stamp"), _union(states).join(nodes.select("node", "stamp"), "stamp").drop("stamp")


def leader_tree(signatures: DataFrame, bits: int, stay: float = 0.8, split: float = 0.5) -> DataFrame:
    """(node, parent, bits) of a tree over all flat signatures, in order of id; nodes without bits have an empty array."""
    if not 0 <= split < stay:
        raise ValueError("0 <= split < stay")
    _, nodes, own = _grow(signatures, Flat(bits), stay, split)
    return nodes.join(own, "node", "left").select("node", "parent", F.coalesce("bits", F.array().cast("array<int>")).alias("bits"))
