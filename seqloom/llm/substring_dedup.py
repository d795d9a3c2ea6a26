"""Repeated passages by relative Lempel-Ziv parsing against the whole corpus.

The reference is the corpus, in blocks. Its index holds anchors: of every window of WINDOW words the least SEED-word run, by
hash (about one word in fifteen starts an anchor). All blocks' anchors meet in hash buckets, so a document is factored
against every reference block at once, wherever its text also is.

1. Anchors carry a digest of their context: all words that any window with this anchor can hold. A context found twice makes
   every window of the anchor repeated, and the bucket answers with a source: the first other place (block and word) that holds
   the context. These are the interiors of the factors.
2. An anchor found with several contexts lies at a factor's boundary, where two copies part. Its windows' own digests are
   sent to the buckets, and those found twice are repeated too, with a source of their own.
3. A document is parsed from left to right: a factor goes on while the next window is repeated and its source is the next
   window of the same source, so a factor is a copy of WINDOW words at least from one place of the reference. The next factor
   begins with the first window whose source is another. Words of factors are the duplicate spans.

A window is repeated exactly if its words also start anywhere else, same document included: both copies hold the same
anchor at the same place in the window, and their contexts are either equal (1) or both sent (2). Digests have 128 bits in
step 1 and 96 in step 2.

Nulls, empty texts and texts shorter than a window have no spans. Repeated rows cover each other wholly if they are as long as
a window. All rows and columns stay; a null text stays null.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .blocks import ASKED, BLOCK_BYTES, Blocks, asked, bucket_of, buckets_for, in_buckets, packed, release, unpacked
from .common import documents, fresh, grams, hashed_words, mix, new_path, written

WINDOW, SEED = 35, 8
#: UTF-8 bytes of a block: its words are held with several numbers each.
BLOCK = 4_000_000
#: Bits of a place in a block that share a key with an anchor's hash: as many as an Arrow string has bytes.
PLACE_BITS = 31
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64))))[:n]


class Parsed:
    """A block's words as hashes, its windows and their anchors."""

    def __init__(self, table: pa.Table, window: int = WINDOW, seed: int = SEED):
        order = np.argsort(table["place"].to_numpy(), kind="stable")
        self.table = table.take(pa.array(order)) if len(order) > 1 else table
        self.block, self.window = table["block"][0].as_py(), window
        h, starts = hashed_words(self.table["t"])
        self.starts, self.lengths = starts, np.diff(starts)
        n = self.n = len(h)
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.valid = np.zeros(n, bool)  # a window starts here
        if n >= window:
            self.valid[: n - window + 1] = doc[: n - window + 1] == doc[window - 1 :]
        self.at = np.flatnonzero(self.valid)
        if not len(self.at):
            self.anchor = self.at
            self.anchors = np.zeros(0, np.int64)
            self.seeds = self.contexts = np.zeros(0, np.uint64)
            return
        seeds = grams(h, seed)
        # least (hash, place) of the seeds in a window, by doubling
        key = (seeds >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(seeds), dtype=np.uint64)
        span, width, least = window - seed + 1, 1, key
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        self.anchor = (least[self.at] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        self.anchors = np.unique(self.anchor)
        self.seeds = seeds[self.anchors]
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n), dtype=np.uint64)))
            self._sums, self._inverse = sums, _powers(_INVERSE, n)
        reach = window - seed
        lo = np.maximum(self.anchors - reach, starts[doc[self.anchors]])
        hi = np.minimum(self.anchors + seed + reach, starts[doc[self.anchors] + 1])
        self.contexts = mix(self.digest(lo, hi) ^ mix((self.anchors - lo).astype(np.uint64) * np.uint64(131) + (hi - self.anchors).astype(np.uint64), 5), 7)

    def digest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the words lo to hi (exclusive), the same wherever they are."""
        with np.errstate(over="ignore"):
            return mix((self._sums[hi] - self._sums[lo]) * self._inverse[lo], 3)


class Distinct:
    """A block's distinct pairs of keys in order, and where each was first and (-1: nowhere) next."""

    def __init__(self, a: np.ndarray, b: np.ndarray, at: np.ndarray):
        order = np.lexsort((at, b, a))
        x, y = a[order], b[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.pair = np.empty(len(x), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        self.a, self.b, self.first = x[new], y[new], at[order[first]]
        again = np.append(~new, False)[first + 1] if len(first) else np.zeros(0, bool)
        self.next = np.full(len(first), -1)
        self.next[again] = at[order[first[again] + 1]]

    def rows(self, block: int, buckets: int) -> pa.Table:
        return asked(block, bucket_of(self.a, buckets), buckets, self.a, self.b, self.first.astype(np.uint32), self.next >= 0)


class Sources:
    """For each entry that a block sent: state (1: found elsewhere, 2: one of several contexts) and the place of a copy."""

    def __init__(self, p: Parsed, sent: Distinct, at: np.ndarray, answers: pa.Table):
        order = np.argsort(answers["bucket"].to_numpy(), kind="stable")
        data, ns = answers["data"].to_pylist(), answers["n"].to_pylist()
        parts = []
        for i in order.tolist():
            state = np.frombuffer(data[i], np.uint8, ns[i])
            k = int((state & 1).sum())
            parts.append((state, np.frombuffer(data[i], np.int64, k, ns[i]), np.frombuffer(data[i], np.int64, k, ns[i] + 8 * k)))
        state, block, place = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else ((), (), ())))
        blocks, places = np.full(len(state), -1), np.full(len(state), -1)
        twice = (state & 1) > 0
        blocks[twice], places[twice] = block, place
        # the first copy of all has its next in the same block, if nowhere else
        own = twice & (places < 0)
        blocks[own], places[own] = p.block, sent.next[own]
        self.state, self.block, self.place = state[sent.pair], blocks[sent.pair], places[sent.pair]
        # a block's later copies point to its first
        later = at != sent.first[sent.pair] if len(at) else np.zeros(0, bool)
        self.block[later], self.place[later] = p.block, sent.first[sent.pair][later]


def _answer(b_type):
    """Of each entry: 1 if its pair is found twice, 2 more if its first key has several second ones; and where its first copy
    is, in order of block and place (of that copy itself: where the second one is, -1 in its own block)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["block"].to_numpy(), kind="stable")))
        ns = rows["n"].to_pylist()
        parts = [unpacked(d, n, np.uint64, b_type, np.uint32, np.bool_) for n, d in zip(ns, rows["data"].to_pylist(), strict=True)]
        a, b, place, again = (np.concatenate(x) for x in zip(*parts, strict=True))
        block = np.repeat(rows["block"].to_numpy(), ns)
        order = np.lexsort((b, a))  # entries of a pair stay in order of block
        x, y = a[order], b[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(x)))
        group = np.cumsum(new) - 1
        twice = (size > 1) | again[order[first]]
        several = np.zeros(len(first), bool)
        same = x[first][1:] == x[first][:-1]
        several[1:] |= same
        several[:-1] |= same
        source = order[first][group]
        second = first[size > 1]
        source[second] = order[second + 1]
        alone = first[size == 1]
        state, blocks, places = np.empty(len(x), np.uint8), np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        state[order] = (twice + 2 * several)[group]
        blocks[order], places[order] = block[source], place[source]
        places[order[alone]] = -1
        out, at = [], 0
        for bucket, own, n in zip(rows["bucket"].to_pylist(), rows["block"].to_pylist(), ns, strict=True):
            s = state[at : at + n]
            found = at + np.flatnonzero(s & 1)
            out.append((bucket, own, n, s.tobytes() + blocks[found].tobytes() + places[found].tobytes()))
            at += n
        return packed(out)

    return run


def _send_anchors(buckets: int, window: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        p = Parsed(table, window, seed)
        return Distinct(p.seeds, p.contexts, p.anchors).rows(p.block, buckets)

    return run


def _anchor_sources(p: Parsed, answers: pa.Table) -> Sources:
    return Sources(p, Distinct(p.seeds, p.contexts, p.anchors), p.anchors, answers)


def _edge_windows(p: Parsed, state: np.ndarray) -> tuple[np.ndarray, Distinct]:
    """The windows to be compared one by one: places in p.at, and their digests and checks."""
    which = np.flatnonzero((state[np.searchsorted(p.anchors, p.anchor)] & 2) > 0) if len(p.at) else np.zeros(0, np.int64)
    starts = p.at[which]
    digests = p.digest(starts, starts + p.window) if len(which) else np.zeros(0, np.uint64)
    seeds = p.seeds[np.searchsorted(p.anchors, p.anchor[which])] if len(which) else np.zeros(0, np.uint64)
    return which, Distinct(digests, (seeds >> np.uint64(32)).astype(np.uint32), starts)


def _send_windows(buckets: int, window: int, seed: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return packed([])
        p = Parsed(table, window, seed)
        return _edge_windows(p, _anchor_sources(p, answers).state)[1].rows(p.block, buckets)

    return run


class Factors:
    """A block's factors in order: places of their first words in the block, lengths, and the places they are copied from."""

    def __init__(self, p: Parsed, answers: pa.Table, edges: pa.Table):
        anchors = _anchor_sources(p, answers)
        near = np.searchsorted(p.anchors, p.anchor)
        repeated = (anchors.state[near] & 1) > 0
        block, place = anchors.block[near], anchors.place[near] - (p.anchor - p.at)
        which, sent = _edge_windows(p, anchors.state)
        own = Sources(p, sent, p.at[which], edges)
        # a window that a context vouches for keeps that source
        more = ((own.state & 1) > 0) & ~repeated[which]
        block[which[more]], place[which[more]] = own.block[more], own.place[more]
        repeated[which[more]] = True
        at, block, place = p.at[repeated], block[repeated], place[repeated]
        goes_on = (np.diff(at) == 1) & (np.diff(block) == 0) & (np.diff(place) == 1)
        first = np.flatnonzero(np.concatenate(([True], ~goes_on))) if len(at) else at
        last = np.append(first[1:], len(at)) - 1 if len(at) else at
        self.start, self.length = at[first], at[last] - at[first] + p.window
        self.block, self.place = block[first], place[first]
        cover = np.zeros(p.n + 1, np.int64)
        np.add.at(cover, self.start, 1)
        np.add.at(cover, self.start + self.length, -1)
        self.covered = np.cumsum(cover[:-1]) > 0
        self.cuts = np.searchsorted(self.start, p.starts)


def parse(df: DataFrame, function, schema, text: str = "text", window: int = WINDOW, seed: int = SEED) -> tuple[Blocks, DataFrame]:
    """(blocks, function(block of documents, repeated words of each, its factors, bounds of each document's) for every block).

    The block's table has the columns of df as c0, c1, ... without the text, which is t. The blocks must stay until the rows
    (of `schema`) have been written.
    """
    spark = df.sparkSession
    blocks = Blocks(df, text, min(BLOCK, BLOCK_BYTES))

    def kept(answers: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        answers.write.option("compression", "zstd").parquet(path)
        release(spark)
        return spark.read.schema(ASKED).parquet(path)

    # about one anchor in fifteen words
    answers = kept(in_buckets(blocks.ask(_send_anchors(buckets_for(blocks.bytes // 60), window, seed)), _answer(np.uint64), ASKED), "anchors")
    edges = kept(in_buckets(blocks.ask_with(answers, _send_windows(buckets_for(blocks.bytes // 12), window, seed), ASKED), _answer(np.uint32), ASKED), "edges")
    both = answers.withColumn("step", F.lit(1)).unionByName(edges.withColumn("step", F.lit(2)))

    def run(table: pa.Table, rows: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema_table([], schema)
        p = Parsed(table, window, seed)
        step = rows["step"].to_numpy()
        f = Factors(p, rows.filter(pa.array(step == 1)), rows.filter(pa.array(step == 2)))
        return function(p.table, np.split(f.covered, p.starts[1:-1]), f, p)

    return blocks, blocks.ask_with(both, run, schema)


def schema_table(rows: list[tuple], schema) -> pa.Table:
    target = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [[] for _ in target]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def strip_repeats(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """df with repeated passages cut out of its text: the words left, joined by a space; texts without any stay as they are, null too."""
    schema = df.schema
    at = df.columns.index(text)
    (none,) = fresh(df, "no_text")

    def run(table: pa.Table, repeated, factors, parsed) -> pa.Table:
        flag = table[f"c{len(schema)}"].to_pylist()
        new = [None if null else b" ".join(compress(x.encode().split(), (~r).tolist())).decode("utf-8", "replace") if r.any() else x for x, null, r in zip(table["t"].to_pylist(), flag, repeated, strict=True)]
        names = [f"c{i}" for i in range(len(schema)) if i != at]
        out = {n: table[n] for n in names} | {f"c{at}": pa.chunked_array([pa.array(new, pa.string())])}
        return pa.table([out[f"c{i}"] for i in range(len(schema))], names=schema.names)

    blocks, out = parse(df.withColumn(none, F.col(f"`{text}`").isNull()), run, schema, text, window)
    out = written(out, "stripped")
    blocks.drop()
    return out


FACTORS = StructType([StructField(n, LongType()) for n in ("block", "start", "length", "source_block", "source_start")])


def factors(df: DataFrame, text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(blocks, factors): blocks has (block, place, t); a factor is `length` words from word `start` of its block on, which are
    also those from `source_start` on in the source's block. Words are counted over the block's texts in order of place."""

    def run(table: pa.Table, repeated, f, parsed) -> pa.Table:
        own = np.full(len(f.start), parsed.block)
        return pa.table([pa.array(x.astype(np.int64)) for x in (own, f.start, f.length, f.block, f.place)], names=FACTORS.names)

    blocks, out = parse(df.select(text), run, FACTORS, text, window)
    return blocks.table, out


def op7_rlz(spark, sf_dir: str) -> DataFrame:
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, longest_factor long")

    def run(table: pa.Table, repeated, f, parsed) -> pa.Table:
        rows = []
        for doc, x, r, a, b in zip(table["c0"].to_pylist(), table["t"].to_pylist(), repeated, f.cuts[:-1].tolist(), f.cuts[1:].tolist(), strict=True):
            words = x.encode("utf-8", "surrogatepass").split()
            kept = compress(words, (~r).tolist()) if b > a else words
            rows.append((doc, len(words), int(r.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), b - a, int(f.length[a:b].max()) if b > a else 0))
        return schema_table(rows, schema)

    return parse(documents(spark, sf_dir).select("doc_id", "text"), run, schema)[1]
