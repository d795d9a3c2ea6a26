"""Alignment of two tokenizers' tokens by byte-owner arrays.

Both tokenizers encode space + text. Their token indices, repeated over the bytes each token covers, give two arrays: the owner of every
byte in A and in B. Runs of one owner pair are overlaps; where both owners change at once, both tokens end, and such cuts part the
text into groups. A link is a pair of tokens that end at one cut. An id pair's count is the number of links of the whole table that
hold it.

No token of either side reaches over a cut before a single space between words, where both files are of the usual make: a byte-level BPE
that splits at white space, and a model without normaliser whose pieces hold the space mark at their start only. Such units
(a space and what follows) are then encoded and aligned once for each block that has them; files of another make are encoded text by text.

Null and empty texts, and texts whose joined bytes in A or B aren't space + text (a mark of the model within the text, a
normaliser that rewrites), have no tokens: zeros and an empty digest. Repeated rows align alike and count each; ties for a B id's
highest count are all best; an empty table gives an empty one. Columns of the result replace equally named ones of the input.
Blocks name each id pair once (keyed_blocks.py), so a pair that a third of all links hold moves one row a block; a B id has at
most as many pairs as A has ids.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType

from .common import documents, written
from .keyed_blocks import Keyed, KeyedBlocks, per_document, summed
from .sentencepiece_codec import BYTE, MARK, parse, separable

#: A pair's number is A's id times SIDE plus B's id; characters of one call of a library (one unit at least).
SIDE, BATCH_CHARS = 1 << 24, 1_000_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer's ids and the bytes of each; `units`: whether units can be encoded one by one."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            with open(path, "rb") as f:
                m = parse(f.read())
            if not m.dummy_prefix:
                raise ValueError("the model adds no space before a text")
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.units = separable(m) and not m.charsmap and not m.remove_extra
            self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]
            self.encode = lambda texts: self.model.encode([x[1:] for x in texts], num_threads=1)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            with open(path) as f:
                spec = json.load(f)
            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            t.encode_special_tokens = True
            before = spec["pre_tokenizer"] or {}
            if before.get("type") != "ByteLevel":
                raise ValueError("only byte-level files say which bytes a token has")
            self.units = not spec["normalizer"] and before["use_regex"] and not before["add_prefix_space"] and all(x["special"] for x in spec["added_tokens"])
            letters = byte_letters()
            tokens = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
            self.bytes = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in tokens]
            self.encode = lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.bytes = np.array([*self.bytes, None], object)[:-1]
        self.text = {mark: np.array([b"%d%s" % (i, mark) for i in range(len(self.bytes))], object) for mark in (b",", b"|", b";")}

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds of each text's)."""
        sizes, flat, part, chars = [np.zeros(1, np.int64)], [], [], 0
        for i, x in enumerate(texts):
            part.append(x)
            chars += len(x)
            if chars >= BATCH_CHARS or i == len(texts) - 1:
                got = self.encode(part)
                n = np.fromiter(map(len, got), np.int64, len(got))
                sizes.append(n)
                flat.append(np.fromiter(chain.from_iterable(got), np.int64, int(n.sum())))
                part, chars = [], 0
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), np.cumsum(np.concatenate(sizes))


_sides: dict[str, Side] = {}


def side(path: str) -> Side:
    if path not in _sides:
        _sides[path] = Side(path)
    return _sides[path]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units of texts begin: at each text, and at each space between two characters that are no white space.

    Characters beyond ASCII that may be white space, judged by their bytes, count as such.
    """
    b = np.concatenate((np.full(3, 32, np.uint8), data, np.full(1, 32, np.uint8)))
    here = np.flatnonzero(data == 32) + 3
    before, second, third = b[here - 1], b[here - 2], b[here - 3]
    wide = ((third >= 0xE1) & (third <= 0xE3) & np.isin(second, (0x80, 0x81, 0x9A))) | ((second == 0xC2) & np.isin(before, (0x85, 0xA0)))
    after = b[here + 1]
    plain = (before > 32) & (before != 0x7F) & ~wide & (after > 32) & (after != 0x7F) & ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))
    starts = offsets[:-1][np.diff(offsets) > 0]
    return np.union1d(starts, here[plain] - 3)


class Aligned:
    """Distinct units, aligned: whether each comes back whole, its numbers of tokens, groups and overlaps, its links (bounds, pairs) and its
    groups as text."""

    def __init__(self, units: list[str], a: Side, b: Side):
        sides = []
        raw = [x.encode() for x in units]
        ok = np.ones(len(units), bool)
        for s in (a, b):
            ids, bounds = s.ids(units)
            joined = b"".join(s.bytes[ids].tolist())
            upto = np.concatenate(([0], np.cumsum(s.sizes[ids])))[bounds]
            if joined != b"".join(raw) or not np.array_equal(np.diff(upto), np.fromiter(map(len, raw), np.int64, len(raw))):
                ok &= np.fromiter((joined[x:y] == r for x, y, r in zip(upto[:-1].tolist(), upto[1:].tolist(), raw, strict=True)), bool, len(raw))
            sides.append((s, ids, bounds))
        self.ok = ok
        owners, kept = [], []
        for s, ids, bounds in sides:
            ids = ids[np.repeat(ok, np.diff(bounds))]
            bounds = np.concatenate(([0], np.cumsum(np.diff(bounds) * ok)))
            owners.append(np.repeat(np.arange(len(ids)), s.sizes[ids]))
            kept.append((ids, bounds))
        (ids_a, at_a), (ids_b, at_b) = kept
        owner_a, owner_b = owners
        last = np.ones(min(len(owner_a), 1), bool)
        new_a, new_b = np.concatenate((owner_a[1:] != owner_a[:-1], last)), np.concatenate((owner_b[1:] != owner_b[:-1], last))
        cuts = np.flatnonzero(new_a & new_b)
        cut_a, cut_b = owner_a[cuts], owner_b[cuts]  # the tokens that end groups
        groups = lambda upto: np.searchsorted(cut_a, upto)
        self.n_a, self.n_b = np.diff(at_a), np.diff(at_b)
        self.bounds = groups(at_a)  # a group has one link
        overlaps = np.concatenate(([0], np.cumsum(new_a | new_b)))
        ends = np.concatenate(([0], np.cumsum(a.sizes[ids_a])))[at_a]
        self.n_overlaps = np.diff(overlaps[ends])
        self.pairs = ids_a[cut_a] * SIDE + ids_b[cut_b]
        # the groups as text: A's tokens of a group, then B's
        group_a, group_b = np.searchsorted(cut_a, np.arange(len(ids_a))), np.searchsorted(cut_b, np.arange(len(ids_b)))
        place_a = np.arange(len(ids_a)) + np.concatenate(([0], cut_b + 1))[group_a]
        place_b = np.arange(len(ids_b)) + (cut_a + 1)[group_b]
        text = np.empty(len(ids_a) + len(ids_b), object)
        text[place_a], text[place_b] = a.text[b","][ids_a], b.text[b","][ids_b]
        text[place_a[cut_a]], text[place_b[cut_b]] = a.text[b"|"][ids_a[cut_a]], b.text[b";"][ids_b[cut_b]]
        text, at = text.tolist(), (at_a + at_b).tolist()
        self.text = [b"".join(text[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]


def aligned(texts: pa.Array, a: Side, b: Side) -> Keyed:
    """The id pairs of each text's links; n_a, n_b, n_groups, n_overlaps and the digest of groups as figures."""
    full = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", texts.type), pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
    full = full.cast(pa.large_string())
    _, offsets, data = full.buffers()
    offsets = np.frombuffer(offsets, np.int64)[full.offset : full.offset + len(full) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[: offsets[-1]] if data else np.zeros(0, np.uint8)
    starts = unit_starts(bytes_, offsets) if a.units and b.units else offsets[:-1][np.diff(offsets) > 0]
    bounds = np.searchsorted(starts, offsets)
    unit_offsets = pa.py_buffer(np.concatenate((starts, offsets[-1:])).astype(np.int64).tobytes())
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, unit_offsets, data]).dictionary_encode() if len(starts) else pa.array([], pa.large_string()).dictionary_encode()
    at, units = coded.indices.to_numpy(), Aligned(coded.dictionary.to_pylist(), a, b)
    n = len(texts)
    whole = (np.diff(bounds) > 0) & (summed((~units.ok)[at], bounds) == 0)
    at = at[np.repeat(whole, np.diff(bounds))]
    bounds = np.concatenate(([0], np.cumsum(np.diff(bounds) * whole)))
    # pairs of a text: its units' links one after the other
    keys, pair = np.unique(units.pairs, return_inverse=True)
    links = np.diff(units.bounds)[at]
    upto = np.concatenate(([0], np.cumsum(links)))
    which = pair[np.repeat(units.bounds[at] - upto[:-1], links) + np.arange(upto[-1])]
    used = np.unique(which)  # pairs of units that only broken texts have go
    place = np.zeros(len(keys), np.int64)
    place[used] = np.arange(len(used))
    ptr, held, times = per_document(place[which], upto[bounds], len(used))
    lists, order, cuts = units.text, at.tolist(), bounds.tolist()
    digests = [hashlib.sha256(b"".join(map(lists.__getitem__, order[x:y]))[:-1]).hexdigest() if ok else "" for x, y, ok in zip(cuts[:-1], cuts[1:], whole.tolist(), strict=True)]
    figures = [summed(f[at], bounds) for f in (units.n_a, units.n_b, np.diff(units.bounds), units.n_overlaps)]
    return Keyed(pa.array(keys[used]), ptr, held, times, [*(pa.array(f) for f in figures), pa.array(digests, pa.string()) if n else pa.array([], pa.string())])


def align(df: DataFrame, a: str, b: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df, or its columns `keep`, with n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum and groups_sha256.

    `a` is a byte-level file of the tokenizers library, `b` a sentencepiece model that adds a space; every executor has both.
    """
    figures = [("n_a", LongType()), ("n_b", LongType()), ("n_groups", LongType()), ("n_overlaps", LongType()), ("groups_sha256", StringType())]
    blocks = KeyedBlocks(df, text, lambda t: aligned(t, side(a), side(b)), LongType(), df.columns if keep is None else keep, figures)
    entries = blocks.entries().repartition("key")
    counts = entries.groupBy("key").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("key") % SIDE))  # at most as many rows as A has ids
    best = counts.select("key", "count", (F.col("count") == most).cast("long").alias("best"))
    back = entries.select("block", "at", "key").join(best, "key")

    def weigh(block: Keyed, values: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array(summed(v[block.at] * block.times, block.bounds)) for v in values]

    out = written(blocks.with_values(back, ["best", "count"], weigh, [("n_best", LongType()), ("count_sum", LongType())]), "aligned")
    blocks.drop()
    return out.withColumn("n_links", F.col("n_groups"))


def op12_byte_owners(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
