"""Pairs of windowed signatures, block by block, as in block_pairs.

Sequences are dealt to blocks by a hash of their ids. Two blocks meet in one task, which joins their bits window by window through sorted
keys, some rows of the first at once, and adds up each pair's windows there; only pairs that share a bit in some window leave it.
So neither the bits that two windows share nor the windows that two sequences share are ever rows of a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.storage import written
from . import block_pairs

PACKED = "block long, ids binary, sizes binary, counts binary, windows binary, bits binary"


@dataclass
class Side:
    """Sequences of a block: ids, set bits, windows, and a row a set bit (row of the sequence, window, bit) in this order."""

    ids: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray
    windows: np.ndarray
    bits: np.ndarray

    def __post_init__(self):
        self.rows = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))

    def at(self, span: int) -> np.ndarray:
        return self.rows * span + self.windows


@dataclass
class Shared:
    """Pairs i < j of sequences, and in order of pair the windows in which they share bits: its number, common bits, and the set bits of both."""

    i: np.ndarray
    j: np.ndarray
    first: np.ndarray  # where each pair's windows begin
    window: np.ndarray
    inter: np.ndarray
    na: np.ndarray
    nb: np.ndarray
    sizes: tuple[np.ndarray, np.ndarray]  # set bits of each pair's sequences
    counts: tuple[np.ndarray, np.ndarray]  # and their windows
    common: tuple[np.ndarray, np.ndarray]  # their set bits in the windows that both have

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first)

    def jaccard(self) -> np.ndarray:
        return self.inter / (self.na + self.nb - self.inter)


def _pack(t: pa.Table) -> pa.Table:
    t = t.sort_by("seq_id")
    lists = [t[c].combine_chunks().flatten().to_numpy() for c in ("windows", "bits")]
    row = [t["seq_id"].to_numpy(), t["n"].to_numpy(), t["count"].to_numpy(), *lists]
    return pa.table([pa.array([t["block"][0].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], names=["block", "ids", "sizes", "counts", "windows", "bits"])


def _side(row: dict, of: str) -> Side:
    kinds = {"ids": np.int64, "sizes": np.int64, "counts": np.int64, "windows": np.int32, "bits": np.int32}
    return Side(*(block_pairs.array(row[f"{of}_{c}"], k).astype(np.int64) for c, k in kinds.items()))


def shared(x: Side, y: Side, same: bool):
    """Shared windows of the pairs of two blocks, some rows of x at once."""
    span = int(max(x.windows.max(initial=0), y.windows.max(initial=0), x.counts.max(initial=0), y.counts.max(initial=0))) + 1
    key, theirs = x.windows << 32 | x.bits, y.windows << 32 | y.bits
    order = np.argsort(theirs, kind="stable")
    theirs, posted = theirs[order], y.rows[order]
    start = np.searchsorted(theirs, key, "left")
    each = np.searchsorted(theirs, key, "right") - start
    upto = np.concatenate(([0], np.cumsum(each)))[x.bounds]
    atx, aty, m = x.at(span), y.at(span), len(y.ids)
    inside = lambda at, where: np.searchsorted(at, where + 1) - np.searchsorted(at, where)
    low = 0
    while low < len(x.ids):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + block_pairs.POSTINGS, "right")) - 1)
        rows = slice(x.bounds[low], x.bounds[high])
        n = each[rows]
        place = np.arange(n.sum()) + np.repeat(start[rows] - (np.cumsum(n) - n), n)
        code = (np.repeat(x.rows[rows], n) * m + posted[place]) * span + np.repeat(x.windows[rows], n)
        low = high
        if same:  # ids of a block are in order
            code = code[code // span // m < code // span % m]
        if not len(code):
            continue
        code, inter = np.unique(code, return_counts=True)
        pair, window = code // span, code % span
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        a, b = pair // m, pair % m
        na, nb = inside(atx, a * span + window), inside(aty, b * span + window)
        a, b = a[first], b[first]
        swap = x.ids[a] > y.ids[b]
        both = lambda u, v, swap=swap: (np.where(swap, v, u), np.where(swap, u, v))
        of_hit = np.repeat(swap, np.diff(np.concatenate((first, [len(pair)]))))
        last = np.minimum(x.counts[a], y.counts[b])
        common = both(np.searchsorted(atx, a * span + last) - x.bounds[a], np.searchsorted(aty, b * span + last) - y.bounds[b])
        yield Shared(*both(x.ids[a], y.ids[b]), first, window, inter, np.where(of_hit, nb, na), np.where(of_hit, na, nb), both(x.sizes[a], y.sizes[b]), both(x.counts[a], y.counts[b]), common)


def each_two(bits: DataFrame, function: Callable[[Shared], dict], schema: str, window_counts: DataFrame | None = None) -> DataFrame:
    """Columns that function makes of all pairs of sequences that share a bit in some window. bits: (seq_id, window_id, bit).

    The number of a sequence's windows comes from window_counts (seq_id, n), else from its last window.
    """
    entry = F.struct(F.col("window_id").cast("int").alias("window"), F.col("bit").cast("int").alias("bit"))
    lists = bits.groupBy(F.col("seq_id").cast("long").alias("seq_id")).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    lists = lists.select("seq_id", F.size("x").cast("long").alias("n"), F.col("x.window").alias("windows"), F.col("x.bit").alias("bits"))
    if window_counts is None:
        rows = lists.withColumn("count", F.array_max("windows").cast("long") + 1)
    else:
        rows = lists.join(window_counts.select("seq_id", F.col("n").cast("long").alias("count")), "seq_id")
    rows = written(rows, "windows")
    of = rows.agg(block_pairs.many()).first()[0]
    blocks = block_pairs.packed(rows.withColumn("block", F.pmod(F.xxhash64("seq_id"), F.lit(of))), _pack, PACKED)

    def run(row: dict):
        same = row["a_block"].as_py() == row["b_block"].as_py()
        x = _side(row, "a")
        for found in shared(x, x if same else _side(row, "b"), same):
            yield pa.table(function(found))

    return block_pairs.meeting(blocks, blocks, F.col("a_block") <= F.col("b_block"), run, schema)
