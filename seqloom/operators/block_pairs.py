"""Pairs of signatures, block by block.

Rows are dealt to blocks by their number of set bits, so a block holds BLOCK rows of like size on average; each two blocks whose
sizes allow a result meet in one task. A block is one row of packed arrays, written once; tasks read the files of the two blocks where
they lie (a cartesian product of two scans), so blocks are neither shuffled nor copied, and disk grows with the rows, not with the pairs. The
task counts common bits by products of matrices for the bits that are worth a column, and by walking posting lists for the others. It
holds two blocks, whatever the number of rows is. All pairs are compared by definition of what uses this; only what is asked for leaves
the task.

Where only near pairs are asked for (`near`), rows are folded to few cells first, a cell being the parity of its bits: cells that differ are bits
that differ at least, so most pairs are left out by a much smaller product, and only the others' bits are counted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.storage import written

#: Rows of a block; columns of a matrix at most, for bits whose pairs of postings are more than all pairs of rows by WORTH; pairs of postings that are added up at once.
BLOCK, COLUMNS, WORTH, POSTINGS = 2000, 2048, 300, 1_000_000
#: Cells for each bit by which rows may differ, and cells of a row at least; words of both blocks' packed rows at most.
CELLS, LEAST, WORDS = 4.8, 64, 8_000_000
#: Set bits of a block, about; rows of the first block whose results leave the task at once; files of a table of blocks at most.
BITS, SLICE, FILES = 4_000_000, 500, 64
PACKED = "block long, lo long, hi long, ids binary, sizes binary, bits binary"


def many() -> Column:
    """Blocks that so many rows and bits (n) make."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.coalesce(F.sum("n"), F.lit(0)) / BITS, F.lit(1))).cast("long")


def blocked(rows: DataFrame) -> DataFrame:
    """rows (seq_id, n, bits) with their block."""
    total = rows.count()
    some = max(1, -(-total // BLOCK))
    cuts = sorted(set(rows.approxQuantile("n", [k / some for k in range(1, some)], 0.2 / some))) if some > 1 else []
    place = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda c: c < F.col("n")))
    at = rows.withColumn("part", place)
    # sizes that many rows share, and many bits: their part is split by hash
    parts = at.groupBy("part").agg(many().alias("of"))
    return at.join(F.broadcast(parts) if some <= 100_000 else parts, "part").withColumn("block", F.col("part") * F.lit(1 << 32) + F.pmod(F.xxhash64("seq_id"), F.col("of"))).select("seq_id", "n", "bits", "block")


def _pack(t: pa.Table) -> pa.Table:
    t = t.sort_by("seq_id")
    n = t["n"].to_numpy()
    bits = t["bits"].combine_chunks().flatten().to_numpy()
    row = [t["block"][0].as_py(), int(n.min()), int(n.max()), t["seq_id"].to_numpy().tobytes(), n.tobytes(), bits.tobytes()]
    return pa.table([pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "lo", "hi", "ids", "sizes", "bits"])


def _pack_reaching(t: pa.Table) -> pa.Table:
    return _pack(t).append_column("reach", pa.array([t.sort_by("seq_id")["reach"].to_numpy().tobytes()], pa.binary()))


def packed(rows: DataFrame, pack: Callable = _pack, schema: str = PACKED) -> DataFrame:
    """A row a block of rows with their block, written; rows are in order of id."""
    return written(rows.repartition(FILES, "block").groupBy("block").applyInArrow(pack, schema), "packed")


def meeting(a: DataFrame, b: DataFrame, on: Column, run: Callable, schema: str) -> DataFrame:
    """run(batch row as a dict) -> tables, for each row of a with each of b that `on` allows: columns get an a or a b in front. Both are written tables."""
    side = lambda x, of: x.select(*[F.col(c).alias(f"{of}_{c}") for c in x.columns])

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                for table in run({c: batch.column(c)[k] for c in batch.schema.names}):
                    yield from table.to_batches()

    return side(a, "a").hint("shuffle_replicate_nl").join(side(b, "b"), on).mapInArrow(each, schema)


def array(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _block(row: dict, of: str) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    n = array(row[f"{of}_sizes"], np.int64)
    return array(row[f"{of}_ids"], np.int64), n, (array(row[f"{of}_bits"], np.int32), np.concatenate(([0], np.cumsum(n))))


def _matrix(n: int, bounds: np.ndarray, column: np.ndarray, low: int, high: int) -> np.ndarray:
    """Ones where a row has a bit, of the columns from low to high; column: that of each bit, row by row."""
    out, here = np.zeros((n, high - low), np.float32), (column >= low) & (column < high)
    out[np.repeat(np.arange(n), np.diff(bounds))[here], column[here] - low] = 1
    return out


def common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Common bits of each row of x with each of y; rows are given as (bits one after the other, bounds)."""
    (bits, bounds), (others, their) = x, y
    n, m, size = len(bounds) - 1, len(their) - 1, int(max(bits.max(initial=0), others.max(initial=0))) + 1
    dx, dy = np.bincount(bits, minlength=size), np.bincount(others, minlength=size)
    often = np.flatnonzero(dx * dy * WORTH > n * m)
    column = np.full(size, -1)
    column[often] = np.arange(len(often))
    mine, theirs = column[bits], column[others]
    out = np.zeros((n, m), np.float32)
    for low in range(0, len(often), COLUMNS):
        high = min(low + COLUMNS, len(often))
        out += _matrix(n, bounds, mine, low, high) @ _matrix(m, their, theirs, low, high).T
    out = out.astype(np.int32)
    # postings of the other bits that both have, and for each such bit of x all of its postings
    rare = (column < 0) & (dx > 0) & (dy > 0)
    some, kept = rare[others], rare[bits]
    posted = np.repeat(np.arange(m), np.diff(their))[some][np.argsort(others[some], kind="stable")]
    start, mine, of = np.cumsum(np.where(rare, dy, 0)) - dy, bits[kept], np.repeat(np.arange(n), np.diff(bounds))[kept]
    upto = np.concatenate(([0], np.cumsum(dy[mine])))
    at = 0
    while at < len(mine):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + POSTINGS, "right")) - 1)
        each = dy[mine[at:to]]
        place = np.arange(upto[to] - upto[at]) + np.repeat(start[mine[at:to]] - (upto[at:to] - upto[at]), each)
        low, high = int(of[at]), int(of[to - 1]) + 1
        out[low:high] += np.bincount(np.repeat((of[at:to] - low) * m, each) + posted[place], minlength=(high - low) * m).reshape(high - low, m).astype(np.int32)
        at = to
    return out


def _folded(bits: np.ndarray, bounds: np.ndarray, cell: np.ndarray, cells: int, *more: np.ndarray | float) -> np.ndarray:
    """1 where a row has an even number of bits in a cell, else -1; and more columns."""
    n = len(bounds) - 1
    out = np.empty((n, cells + len(more)), np.float32)
    for low in range(0, n, SLICE):
        high = min(low + SLICE, n)
        at = np.repeat(np.arange(high - low) * cells, np.diff(bounds[low : high + 1])) + cell[bits[bounds[low] : bounds[high]]]
        out[low:high, :cells] = 1 - 2 * (np.bincount(at, minlength=(high - low) * cells) & 1).reshape(high - low, cells)
    for k, values in enumerate(more):
        out[:, cells + k] = values
    return out


def close(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], far: np.ndarray, their: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y of pairs whose cells differ in far + their at most: all pairs whose bits do, and some more."""
    (bits, bounds), (others, ends) = x, y
    df = np.bincount(np.concatenate((bits, others)), minlength=1)
    cells = LEAST * max(1, int(np.ceil(CELLS * (far.mean() + their.mean()) / LEAST)))
    # the most frequent bits have half of the cells for themselves
    rank, own = np.empty(len(df), np.int64), cells // 2
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    cell = np.where(rank < own, rank, own + (rank - own) % (cells - own))
    # alike less unlike cells, and twice what may be unlike; half a cell for rounding
    return np.nonzero(_folded(bits, bounds, cell, cells, 2 * far, 1) @ _folded(others, ends, cell, cells, 1, 2 * their).T >= cells - 0.5)


def near(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], far: np.ndarray, their: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, rows of y, common bits) of pairs, in order; all that differ in far + their bits at most are among them."""
    a, b = close(x, y, far, their)
    (bits, bounds), (others, ends) = x, y
    n, m, size = len(bounds) - 1, len(ends) - 1, int(max(bits.max(initial=0), others.max(initial=0))) + 1
    both = (np.bincount(bits, minlength=size) > 0) & (np.bincount(others, minlength=size) > 0)
    words = -(-int(both.sum()) // 64)
    if 16 * len(a) > n * m or (n + m) * words > WORDS:
        return a, b, common(x, y)[a, b].astype(np.int64)
    place = np.where(both, np.cumsum(both) - 1, -1)
    p, q = _words(bits, bounds, place, words), _words(others, ends, place, words)
    inter, step = np.zeros(len(a), np.int64), max(1, POSTINGS // max(words, 1))
    for at in range(0, len(a), step):
        inter[at : at + step] = np.bitwise_count(p[a[at : at + step]] & q[b[at : at + step]]).sum(1, dtype=np.int64)
    return a, b, inter


def _words(bits: np.ndarray, bounds: np.ndarray, place: np.ndarray, words: int) -> np.ndarray:
    """Rows of packed bits, each at its place, if it has one."""
    n = len(bounds) - 1
    out = np.empty((n, words * 8), np.uint8)
    for low in range(0, n, SLICE):
        high = min(low + SLICE, n)
        wide, at = np.zeros((high - low, words * 64), np.uint8), place[bits[bounds[low] : bounds[high]]]
        wide[np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1]))[at >= 0], at[at >= 0]] = 1
        out[low:high] = np.packbits(wide, axis=1, bitorder="little")
    return out.view(np.uint64)


def each_two(signatures: DataFrame, function: Callable, schema: str, least: float = 0.0) -> DataFrame:
    """function(ids, sizes, other ids, other sizes, common bits) for every two blocks in which a Jaccard of `least` can be, SLICE rows of the first at once.

    Each pair of rows is in one of them once: the common bits of a pair that is not to be counted are -1. Signatures without
    bits are left out.
    """

    def run(row: dict):
        (i, m, p), (j, n, q), same = _two(row)
        inter = common(p, q)
        if same:
            inter[i[:, None] >= j[None, :]] = -1
        for at in range(0, len(i), SLICE):
            here = slice(at, at + SLICE)
            yield function(i[here], m[here], j, n, inter[here])

    return _meet(signatures, run, schema, _sized(least))


def _two(row: dict) -> tuple[tuple, tuple, bool]:
    """Both blocks of a row, and whether they are one."""
    same, x = row["a_block"].as_py() == row["b_block"].as_py(), _block(row, "a")
    return x, x if same else _block(row, "b"), same


def _sized(least: float) -> Column:
    """Blocks whose sizes allow a Jaccard of `least`."""
    return (F.col("a_hi") >= F.lit(least) * F.col("b_lo")) & (F.col("b_hi") >= F.lit(least) * F.col("a_lo"))


def _meet(signatures: DataFrame, run: Callable, schema: str, on: Column) -> DataFrame:
    full = signatures.where(F.size("bits") > 0).select(F.col("seq_id").cast("long").alias("seq_id"), F.size("bits").cast("long").alias("n"), F.col("bits").cast("array<int>").alias("bits"))
    blocks = packed(blocked(written(full, "signatures")))
    return meeting(blocks, blocks, (F.col("a_block") <= F.col("b_block")) & on, run, schema)


COUNTED = "i long, j long, na long, nb long, inter long"


def _rows(keep: Callable):
    def run(i, m, j, n, inter) -> pa.Table:
        a, b = np.nonzero(keep(m[:, None], n[None, :], inter))
        return _table(i[a], j[b], m[a], n[b], inter[a, b].astype(np.int64))

    return run


def _table(first: np.ndarray, second: np.ndarray, na: np.ndarray, nb: np.ndarray, inter: np.ndarray) -> pa.Table:
    swap = first > second
    columns = (np.where(swap, second, first), np.where(swap, first, second), np.where(swap, nb, na), np.where(swap, na, nb), inter)
    return pa.table([pa.array(c) for c in columns], names=["i", "j", "na", "nb", "inter"])


def counted(signatures: DataFrame) -> DataFrame:
    """(i, j, na, nb, inter) of all pairs i < j with a common bit."""
    return each_two(signatures, _rows(lambda na, nb, inter: inter > 0), COUNTED)


def similar(signatures: DataFrame, least: float) -> DataFrame:
    """(i, j, similarity) of pairs i < j with Jaccard >= least, which is positive."""
    share = (1 - least) / (1 + least)  # of both rows' bits, that may differ

    def run(row: dict):
        (i, m, p), (j, n, q), same = _two(row)
        a, b, inter = near(p, q, share * m, share * n)
        na, nb = m[a], n[b]
        real = (inter > 0) & (inter >= least * (na + nb - inter)) & ((i[a] < j[b]) | (not same))
        yield _table(i[a][real], j[b][real], na[real], nb[real], inter[real])

    found = _meet(signatures, run, COUNTED, _sized(least))
    return found.select("i", "j", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("similarity")).where(F.col("similarity") >= least)


def apart(signatures: DataFrame, most: float) -> DataFrame:
    """(i, j, hd) of pairs i < j that differ in `most` bits at most; blocks whose sizes differ in more don't meet."""

    def run(row: dict):
        (i, m, p), (j, n, q), same = _two(row)
        a, b, inter = near(p, q, np.zeros(len(i)), np.full(len(j), float(most)))
        hd = m[a] + n[b] - 2 * inter
        real = (hd <= most) & ((i[a] < j[b]) | (not same))
        first, second = i[a][real], j[b][real]
        yield pa.table({"i": pa.array(np.minimum(first, second)), "j": pa.array(np.maximum(first, second)), "hd": pa.array(hd[real])})

    on = (F.col("a_hi") + F.lit(most) >= F.col("b_lo")) & (F.col("b_hi") + F.lit(most) >= F.col("a_lo"))
    return _meet(signatures, run, "i long, j long, hd long", on)


def histogram(signatures: DataFrame) -> DataFrame:
    """(bin, count) of the Jaccard of all pairs of signatures with bits, in tenths of 100; pairs are counted where they are compared."""

    def run(i, m, j, n, inter) -> pa.Table:
        # pairs that reach each tenth: those that reach none are not looked at again
        both, upto = (m[:, None] + n[None, :]).astype(np.int32), np.zeros(12, np.int64)
        upto[0] = np.count_nonzero(inter >= 0)
        for k in range(1, 11):
            upto[k] = np.count_nonzero(inter * (10 + k) >= both * k)
            if not upto[k]:
                break
        found = upto[:-1] - upto[1:]
        return pa.table([pa.array(np.arange(11) * 10, pa.int32()), pa.array(found)], names=["bin", "count"])

    found = each_two(signatures, run, "bin int, count long").groupBy("bin").agg(F.sum("count").alias("count"))
    bins = signatures.sparkSession.range(11).select((F.col("id") * 10).cast("int").alias("bin"))
    return bins.join(found, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def product(items: DataFrame, nodes: DataFrame, least: float = 0.0, best: bool = False, within: float | str | None = None) -> DataFrame:
    """(seq_id, node, alike): Jaccard of items (seq_id, bits) and nodes (node, bits) above `least`, every two blocks in a task.

    With `best`, only the most alike node of a block for each item, ties to the smaller. Pairs without a common bit are left out.
    With `within`, Hamming distances up to that, or to the nodes' own in a column of that name, instead, of pairs without a common bit too. Items and nodes without bits are left out.
    """
    own = isinstance(within, str)
    return against(side(items, "seq_id"), side(nodes, "node", *([F.col(within).cast("double").alias("reach")] if own else [])), least, best, within)


def side(df: DataFrame, key: str, *more: Column) -> DataFrame:
    """Blocks of signatures (key, bits) for `against`; those without bits are left out."""
    rows = df.where(F.size("bits") > 0).select(F.col(key).cast("long").alias("seq_id"), F.size("bits").cast("long").alias("n"), F.col("bits").cast("array<int>").alias("bits"), *more)
    of = rows.agg(many()).first()[0]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("seq_id"), F.lit(of)))
    return packed(dealt, _pack_reaching, f"{PACKED}, reach binary") if more else packed(dealt)


def against(items: DataFrame, nodes: DataFrame, least: float = 0.0, best: bool = False, within: float | str | None = None) -> DataFrame:
    """What product gives, of blocks that side made; nodes' may be the union of several such tables."""
    own = isinstance(within, str)

    def run(row: dict):
        (i, m, p), (j, n, q) = _block(row, "a"), _block(row, "b")
        if within is not None:
            reach = array(row["b_reach"], np.float64) if own else np.full(len(j), float(within))
            at, to, inter = near(p, q, np.zeros(len(i)), reach)
            hd = (m[at] + n[to] - 2 * inter).astype(np.float64)
            real = hd <= reach[to]
            yield pa.table({"seq_id": pa.array(i[at[real]]), "node": pa.array(j[to[real]]), "alike": pa.array(hd[real])})
            return
        inter = common(p, q)
        for low in range(0, len(i), SLICE):
            here = slice(low, low + SLICE)
            yield found(i[here], m[here], j, n, inter[here])

    def found(i, m, j, n, inter) -> pa.Table:
        alike = inter / (m[:, None] + n[None, :] - inter)
        if best:
            at, to = np.arange(len(i)), alike.argmax(1)
            real = (inter[at, to] > 0) & (alike[at, to] > least)
            at, to = at[real], to[real]
        else:
            at, to = np.nonzero((alike > least) & (inter > 0))
        return pa.table({"seq_id": pa.array(i[at]), "node": pa.array(j[to]), "alike": pa.array(alike[at, to])})

    return meeting(items, nodes, F.lit(True), run, "seq_id long, node long, alike double")


def nearest(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seq_id, node, similarity): the most alike node of each item that shares a bit with any; ties to the smaller."""
    found = product(items, nodes, 0.0, best=True).groupBy("seq_id").agg(F.min(F.struct((-F.col("alike")).alias("far"), "node")).alias("x"))
    return found.select("seq_id", "x.node", (-F.col("x.far")).alias("similarity"))
