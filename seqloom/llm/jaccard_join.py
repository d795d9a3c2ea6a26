"""N-gram Jaccard join by parity sketches.

A document's shingles are XOR-ed, by hash, into the segments of a sketch; two sketches differ in at most as many segments (and
bits) as their sets differ in shingles. A pair of sizes a and b with Jaccard at least 3/4 differs in at most (a + b) / 7
shingles, so of a size band's segments all but that many agree. Each document therefore sends, to the band of its size and to
the next smaller one if a partner can be there, D + 1 of its segments in an order all documents share (rarest first, then
by hash; all segments are counted before): two documents within the bound meet in one at least. Segments that no other
document holds need not be sent. Documents that share a segment are a group, and groups are resolved in rounds:

1. every document in a group that still holds several components compares with one centre, the one that most of its groups
   name (a group's centre is its member in most groups): the sketches' Hamming distance first, then the whole sets. Links
   contract components, so what a round adds is at most one link a document. A pair is compared once;
2. after CENTRES rounds, of groups that still hold several components, every pair of different components not compared yet, in
   blocks of PART documents by PART.

So pairs within a component that is known already are never compared, and no link between components is lost. A group of a
rare segment is one row of fewer than HOT documents; a frequent segment's group is never put together: each document carries
the segment's key, and groups are only aggregated by it.

Texts of equal words are one node. Documents without words (null, empty) link with nothing. Texts of fewer than N words are one
shingle of all their words. Ties and repeated rows: a component's id is the smallest id among its members; rows without an id take
the part of any other but give no id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .blocks import ASKED, BLOCK_BYTES, Blocks, asked, bucket_of, buckets_for, in_buckets, packed, release
from .common import documents, dropped, fresh, grams, hashed_words, mix, written
from .graph import components

N = 5
#: Segments over those that must be sent, for large bands; and segments a shingle, for bands of small sets.
SLACK, SPARSE, SMALL = 1.6, 8, 24
#: Rounds of comparing with centres before all pairs of what is left; members of a group that one task compares with as many.
CENTRES, PART = 2, 500
#: UTF-8 bytes of a block: its shingles and segments are held with several numbers each.
BLOCK = 5_000_000
#: 64-bit words of the dense sketch that candidate pairs are compared by first.
DENSE_WORDS = 32
#: Counts of segments in a byte: exact below EXACT, then in sixths of an octave; a segment of HOT documents and more is frequent.
EXACT, HOT = 128, 256


def coded(count: np.ndarray) -> np.ndarray:
    """A count as a byte that keeps the order of counts."""
    more = EXACT + 6 * np.log2(np.maximum(count, EXACT) / EXACT)
    return np.where(count < EXACT, count, np.minimum(more, 255)).astype(np.uint8)


def lanes(most: int = 1 << 40) -> list[int]:
    """Least sizes of the bands: partners of a band's sets have sizes in it or in the next."""
    out = [1]
    while out[-1] < most:
        out.append(4 * out[-1] // 3 + 1)
    return out


_LANES = np.array(lanes(), np.int64)


def _segments(lane: np.ndarray) -> np.ndarray:
    top = _LANES[lane + 1] - 1
    differ = (top + 4 * top // 3) // 7
    return np.where(top < SMALL, SPARSE * (top + 1), np.ceil(SLACK * (differ + 1))).astype(np.int64)


def shingles(texts: pa.Array | pa.ChunkedArray, n: int = N) -> tuple[list[np.ndarray], list[int]]:
    """Of each text the distinct shingles' hashes, sorted, and a digest of its words in order."""
    h, bounds = hashed_words(texts, lower=True)
    g, sets, digests = grams(h, n), [], []
    data = h.tobytes()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(g[a : b - n + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        else:
            x = mix(grams(h[a:b], b - a, 11), 99 + b - a) if b > a else g[:0]
        sets.append(x)
        digests.append(xxhash.xxh3_128_intdigest(data[8 * a : 8 * b]))
    return sets, digests


def dense(s: np.ndarray) -> np.ndarray:
    """The parity of the shingles that hash to each bit."""
    bits = np.bincount((mix(s, 21) % np.uint64(64 * DENSE_WORDS)).astype(np.int64), minlength=64 * DENSE_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def segments(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All segments of all sets in their bands: (key, set, unit, segments to send), a unit being a set in a band."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(_LANES, sizes, "right") - 1
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # a segment is a range of hashes: sorted sets are in order of segment already
    upper, mixed = tokens >> np.uint64(32), mix(tokens, 5)
    out = []
    for lower in (0, 1):
        lane = np.maximum(band - lower, 0)
        top = _LANES[lane + 1] - 1
        if lower:  # the larger of a pair, in its partner's band
            ok = (band > 0) & (sizes <= 4 * top // 3)
            differ = (sizes + top) // 7
        else:
            ok = sizes > 0
            differ = (sizes + 4 * sizes // 3) // 7
        m = np.where(ok, _segments(lane), 0)
        offset = np.concatenate(([0], np.cumsum(m)))
        total = int(offset[-1])
        if not total:
            continue
        mine = slice(None) if ok.all() else ok[owner]
        d, h = owner[mine], mixed[mine]
        place = offset[d] + (upper[mine] * m[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        firsts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        value = np.zeros(total, np.uint64)
        value[place[firsts]] = np.bitwise_xor.reduceat(h, firsts)
        doc = np.repeat(np.arange(len(sets)), m)
        segment = np.arange(total) - offset[doc]
        key = mix(value ^ mix((segment.astype(np.uint64) << np.uint64(8)) + lane[doc].astype(np.uint64), 77), 13)
        out.append((key, doc, doc + lower * len(sets), differ[doc] + 1))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


SURVEYED = StructType([StructField(n, t) for n, t in (("bucket", IntegerType()), ("block", LongType()), ("n", LongType()), ("data", BinaryType()), ("place", LongType()), ("id", LongType()), ("high", LongType()), ("low", LongType()))])


class Block:
    """A block's documents in order: their words' digests, and the sets of those whose words no earlier one has."""

    def __init__(self, table: pa.Table):
        self.table = table.take(pa.array(np.argsort(table["place"].to_numpy(), kind="stable")))
        self.number = table["block"][0].as_py()
        every, self.digests = shingles(self.table["t"])
        self.sets, self.distinct, seen = [], [], {}
        self.first: list[int] = []
        for i, (x, d) in enumerate(zip(every, self.digests, strict=True)):
            if d not in seen:
                seen[d] = len(self.sets)
                self.sets.append(x)
                self.distinct.append(i)
            self.first.append(seen[d])


def _survey(buckets: int):
    """A row for each document (a bucket below 0; n: its set's size), and all segments of a block's distinct documents, to be counted."""

    def run(table: pa.Table) -> pa.Table:
        b = Block(table)
        key, *_ = segments(b.sets)
        key = np.sort(key)
        keys = asked(b.number, bucket_of(key, buckets), buckets, key.astype(np.uint32))
        n, k = len(b.digests), keys.num_rows
        sizes = [len(b.sets[i]) for i in b.first]
        described = [pa.array(np.full(n, -1 - int(mix(np.array([b.number], np.uint64))[0] >> np.uint64(34))), pa.int32()), b.table["block"].combine_chunks(), pa.array(sizes, pa.int64()), pa.nulls(n, pa.binary()), b.table["place"].combine_chunks(), b.table["c0"].combine_chunks(), pa.array([(d >> 64) - (1 << 63) for d in b.digests], pa.int64()), pa.array([(d & (1 << 64) - 1) - (1 << 63) for d in b.digests], pa.int64())]
        names = SURVEYED.names
        return pa.concat_tables([pa.table(described, names=names), pa.table([*(keys[c].combine_chunks() for c in names[:4]), *[pa.nulls(k, pa.int64())] * 4], names=names)])

    return run


def _count(rows: pa.Table) -> pa.Table:
    """How many sets hold each segment, coded; the lower half of the key, in its bucket, stands for it. Other rows pass."""
    if rows["bucket"][0].as_py() < 0:
        return rows
    key = np.concatenate([np.frombuffer(d, np.uint32) for d in rows["data"].to_pylist()])
    _, group, n = np.unique(key, return_inverse=True, return_counts=True)
    count = coded(n)[group]
    out, at = [], 0
    for bucket, block, n in zip(rows["bucket"].to_pylist(), rows["block"].to_pylist(), rows["n"].to_pylist(), strict=True):
        out.append((bucket, block, n, count[at : at + n].tobytes()))
        at += n
    counted = packed(out)
    return pa.table([*(counted[c] for c in SURVEYED.names[:4]), *[pa.nulls(len(out), pa.int64())] * 4], names=SURVEYED.names)


def _send_shared(buckets: int):
    """Of each unit's rarest segments, as many as must be sent, those that another set holds too."""

    def run(table: pa.Table, rows: pa.Table) -> pa.Table:
        counts = rows.filter(pa.compute.is_valid(rows["bucket"]))
        rows = rows.filter(pa.compute.is_valid(rows["node"]))
        if not table.num_rows or not rows.num_rows:
            return _sent([])
        b = Block(table)
        sets = b.sets
        key, doc, unit, send = segments(sets)
        # only the first of a class of equal texts, over all blocks, is a node
        node_of = dict(zip(rows["place"].to_pylist(), rows["node"].to_pylist(), strict=True))
        nodes = np.array([node_of.get(p, -1) for p in b.table["place"].take(pa.array(b.distinct)).to_pylist()], np.int64)
        count = np.empty(len(key), np.uint8)
        by_bucket = np.argsort(counts["bucket"].to_numpy(), kind="stable")
        data = counts["data"].to_pylist()
        count[np.argsort(key, kind="stable")] = np.concatenate([np.frombuffer(data[i], np.uint8) for i in by_bucket])
        ranked = np.argsort((count.astype(np.uint64) << np.uint64(56)) | (key >> np.uint64(8)))
        ranked = ranked[np.argsort(unit[ranked].astype(np.uint16) if 2 * len(sets) < 1 << 16 else unit[ranked], kind="stable")]
        firsts = np.flatnonzero(np.concatenate(([True], unit[ranked][1:] != unit[ranked][:-1])))
        rank = np.arange(len(key)) - np.repeat(firsts, np.diff(np.append(firsts, len(key))))
        chosen = ranked[(rank < send[ranked]) & (count[ranked] > 1) & (nodes[doc[ranked]] >= 0)]
        chosen = chosen[np.argsort(key[chosen])]
        if not len(chosen):
            return _sent([])
        hot = count[chosen] >= coded(np.array([HOT]))[0]
        of = doc[chosen[hot]]
        order = np.argsort(of, kind="stable")
        hot_keys, cut = key[chosen[hot]][order], np.searchsorted(of[order], np.arange(len(sets) + 1))
        out = [(None, len(sets[i]), dense(sets[i]).tobytes(), int(nodes[i]), np.unique(hot_keys[cut[i] : cut[i + 1]]).astype(np.int64)) for i in np.unique(doc[chosen]).tolist()]
        cold = chosen[~hot]
        key, node = key[cold], nodes[doc[cold]]
        base = int(node.min()) if len(node) else 0
        cuts = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
        small = (node - base).astype(np.uint32)
        out += [(b, int(cuts[b + 1] - cuts[b]), key[cuts[b] : cuts[b + 1]].tobytes() + small[cuts[b] : cuts[b + 1]].tobytes(), base, None) for b in range(buckets) if cuts[b + 1] > cuts[b]]
        return _sent(out)

    return run


SENT = "bucket int, n long, data binary, node long, hot array<long>"


def _sent(rows: list[tuple]) -> pa.Table:
    """Rows of a bucket's keys and nodes (as distances from `node`), or, without a bucket, of a node's set size, sketch and frequent segments."""
    b, n, data, node, hot = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "n": pa.array(n, pa.int64()), "data": pa.array(data, pa.binary()), "node": pa.array(node, pa.int64()), "hot": pa.array(hot, pa.list_(pa.int64()))})


def _groups(rows: pa.Table) -> pa.Table:
    """The distinct node sets (of two and more) that share a segment."""
    all_keys, all_nodes = [], []
    for n, data, base in zip(rows["n"].to_pylist(), rows["data"].to_pylist(), rows["node"].to_pylist(), strict=True):
        all_keys.append(np.frombuffer(data, np.uint64, n))
        all_nodes.append(np.frombuffer(data, np.uint32, n, 8 * n).astype(np.int64) + base)
    key, node = np.concatenate(all_keys), np.concatenate(all_nodes)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(cut)
    starts, sizes = cut[:-1][sizes > 1], sizes[sizes > 1]
    seen, out = set(), []
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        raw = node[a : a + n].tobytes()
        digest = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
        if digest not in seen:
            seen.add(digest)
            out.append((digest, node[a : a + n]))
    return pa.table({"set": pa.array([d for d, _ in out], pa.int64()), "nodes": pa.array([x for _, x in out], pa.list_(pa.int64()))})


def _sets(table: pa.Table, wanted: pa.Table) -> pa.Table:
    """(node, items) of the texts of a block that are asked for: (place, node)."""
    own = table["place"].to_numpy()
    order = np.argsort(own)
    at = order[np.searchsorted(own[order], wanted["place"].to_numpy())] if len(own) else order
    sets = shingles(table["t"].take(pa.array(at)))[0]
    return pa.table({"node": wanted["node"].combine_chunks(), "items": pa.array([x.tobytes() for x in sets], pa.binary())})


def _near(batches):
    """(a, b, near) of pairs with both sizes and sketches: whether these allow a link."""
    for batch in batches:
        na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(batch), DENSE_WORDS) for i in (4, 5))
        hamming = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        near = (4 * na >= 3 * nb) & (4 * nb >= 3 * na) & (7 * hamming <= na + nb)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(near)], ["a", "b", "near"])


def _linked(batches):
    """Of pairs with both sets, those with 100 * intersection >= 75 * union."""
    for batch in batches:
        keep = []
        for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x = np.sort(np.concatenate((np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64))), kind="stable")
            both = int((x[1:] == x[:-1]).sum())
            keep.append(100 * both >= 75 * (len(x) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _crossing(rows: pa.Table) -> pa.Table:
    """Of two parts of a group (or of one): the pairs of different components that sizes and sketches allow."""
    node, label, n, part = (rows[c].to_numpy() for c in ("node", "component", "n", "own"))
    sketch = np.frombuffer(b"".join(rows["data"].to_pylist()), np.uint64).reshape(len(node), DENSE_WORDS)
    lo, hi = rows["lo"][0].as_py(), rows["hi"][0].as_py()
    left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    out_a, out_b = [], []
    for i in left.tolist():
        others = right[node[right] > node[i]] if lo == hi else right
        others = others[(label[others] != label[i]) & (4 * n[others] >= 3 * n[i]) & (4 * n[i] >= 3 * n[others])]
        hamming = np.bitwise_count(sketch[others] ^ sketch[i]).sum(1, dtype=np.int64)
        near = others[7 * hamming <= n[others] + n[i]]
        out_a.append(np.minimum(node[near], node[i]))
        out_b.append(np.maximum(node[near], node[i]))
    return pa.table({"a": pa.array(np.concatenate(out_a) if out_a else [], pa.int64()), "b": pa.array(np.concatenate(out_b) if out_b else [], pa.int64())})


def links(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): (node, id, n_shingles) for each row of df, and (node, component) for each node linked to another."""
    spark = df.sparkSession
    blocks = Blocks(df.select(df[key].cast("long").alias("id"), df[text].alias("text")), size=min(BLOCK, BLOCK_BYTES))
    buckets = buckets_for(blocks.bytes // 7)
    surveyed = written(in_buckets(blocks.ask(_survey(buckets), SURVEYED), _count, SURVEYED), "survey")
    release(spark)
    described = surveyed.where("bucket < 0").select("block", "place", "id", "high", "low", F.col("n").alias("n_shingles"))
    # a row's number: its partition and its place there
    uid = F.shiftleft(F.shiftright("block", 32), 40) + F.col("place")
    classes = described.where("n_shingles > 0").groupBy("high", "low").agg(F.min(F.struct(uid.alias("node"), "block", "place")).alias("first"))
    firsts = written(classes.select("high", "low", "first.node", "first.block", "first.place"), "classes")
    counted = surveyed.where("bucket >= 0").select("bucket", "block", "n", "data")
    both = firsts.select("block", "place", "node").unionByName(counted.select("block", "bucket", "data"), allowMissingColumns=True)
    sent = written(blocks.ask_with(both, _send_shared(buckets), SENT), "sent")
    groups = written(in_buckets(sent.where("bucket IS NOT NULL"), _groups, "set long, nodes array<long>"), "groups")
    release(spark)
    # a set of nodes that several segments share is one group; each node's groups are as many as it has segments at most
    cold = groups.groupBy("set").agg(F.first("nodes").alias("nodes")).select("set", F.explode("nodes").alias("node"))
    cold = cold.groupBy("node").agg(F.collect_list("set").alias("cold"))
    member = sent.where("bucket IS NULL").select("node", "n", "data", "hot").join(cold, "node", "left")
    none_ = F.array().cast("array<long>")
    member = written(member.select("node", "n", "data", F.concat(F.coalesce("hot", none_), F.coalesce("cold", none_)).alias("sets")).where(F.size("sets") > 0), "members")
    dropped(sent, groups)
    labels = _resolved(blocks, firsts, member)
    rows = written(described.join(firsts.select("high", "low", "node"), ["high", "low"], "left").select("node", "id", "n_shingles"), "nodes")
    blocks.drop()
    dropped(surveyed, firsts, member)
    release(spark)
    return rows, labels


def _resolved(blocks: Blocks, firsts: DataFrame, member: DataFrame) -> DataFrame:
    """(node, component) of the members (node, n, data, sets)."""
    spark = member.sparkSession

    def compared(pairs: DataFrame) -> DataFrame:
        """(a, b, near) of pairs (a, b)."""
        sketch = lambda x: member.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("data").alias(f"d{x}"))
        return written(pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "na", "nb", "da", "db").mapInArrow(_near, "a long, b long, near boolean"), "pairs")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets link. Texts stay in their blocks."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = firsts.join(ends, "node").select("block", "place", "node")
        sets = written(blocks.ask_with(wanted, _sets, "node long, items binary"), "sets")
        items = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"i{x}"))
        out = written(pairs.select("a", "b").join(items("a"), "a").join(items("b"), "b").select("a", "b", "ia", "ib").mapInArrow(_linked, "a long, b long"), "links")
        dropped(sets)
        release(spark)
        return out

    labels = written(member.select("node", F.col("node").alias("component")), "labels")
    tried = []
    for turn in range(CENTRES + 1):
        each = member.select("node", "sets").join(labels, "node").select("node", "component", F.size("sets").alias("degree"), F.explode("sets").alias("set"))
        best = F.max(F.struct("degree", (-F.col("node")).alias("least"), "node", "component")).alias("x")
        open_sets = each.groupBy("set").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"), best).where("lo <> hi")
        open_sets = written(open_sets.select("set", "members", F.col("x.node").alias("centre"), F.col("x.degree").alias("of"), F.col("x.component").alias("its")), "open")
        if open_sets.isEmpty():
            dropped(open_sets)
            break
        if turn < CENTRES:
            met = each.join(open_sets, "set").where("component <> its").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("shared"), F.max("of").alias("of"))
            pairs = met.select("node", "centre", "shared", "of", F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
            for t in tried:
                pairs = pairs.join(t.select("a", "b"), ["a", "b"], "left_anti")
            pairs = pairs.groupBy("node").agg(F.max(F.struct("shared", "of", (-F.col("centre")).alias("least"), "a", "b")).alias("x")).select("x.a", "x.b").distinct()
            pairs = compared(pairs)
            tried.append(pairs)
            near = pairs.where("near")
        else:
            parts = each.join(open_sets.select("set", F.ceil(F.col("members") / PART).cast("long").alias("parts")), "set")
            parts = parts.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            parts = parts.join(member.select("node", "n", "data"), "node").select("set", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "component", "n", "data")
            near = parts.groupBy("set", "lo", "hi").applyInArrow(lambda t: _crossing(t), "a long, b long").distinct()
            for t in tried:
                near = near.join(t.select("a", "b"), ["a", "b"], "left_anti")
            near = written(near, "pairs")
            tried.append(near)
        more = linked(near)
        # links between components, which they contract: a forest is all that stays
        of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        between = written(more.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "between")
        if not between.isEmpty():
            joined = components(between)
            new = written(labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels")
            dropped(labels, joined)
            labels = new
        dropped(open_sets, more, between)
        release(spark)
    dropped(*tried)
    return labels


def clusters(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of df."""
    rows, labels = links(df, key, text)
    named = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("id").alias("low"))
    return named.join(low, "component", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("low", "id").alias("component_id"))


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component: one of the smallest id, or without an id if none has any. Rows without words all stay.

    Rows are numbered and written first, so that rows of equal ids are told apart.
    """
    number, kept = fresh(df, "number", "kept")
    numbered = written(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows, labels = links(numbered.select(number, text), number, text)
    ids = numbered.select(F.col(number).alias("id"), numbered[key].cast("long").alias("own"))
    named = rows.join(labels, "node", "left").select("id", F.coalesce("component", "node").alias("component")).join(ids, "id")
    first = named.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "id")).alias("x"))
    stay = first.select(F.col("x.id").alias(kept)).unionByName(named.where("component IS NULL").select(F.col("id").alias(kept)))
    return numbered.join(stay, F.col(number) == F.col(kept), "left_semi").drop(number)


def op9_parity_sketch(spark, sf_dir: str) -> DataFrame:
    return clusters(documents(spark, sf_dir))
